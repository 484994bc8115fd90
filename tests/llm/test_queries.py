"""The numbered queries on a given small table: against their SQL, or their columns and keys."""

import re

import pytest

import __spark_entry__ as entry
from sizewise.llm.oracles import ORACLES
from sizewise.llm.queries import QUERIES
from tools.compare import compare

COLUMNS = {
    "op1_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_toxicity": ["doc_id", "p_junk", "p_toxic", "toxic"],
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op8_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}
TABLE = {"op1_embedding_dedup": "embeddings", "op4_html_text": "pages"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    status, detail = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir)
    assert status == "ok", detail


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_whole_table(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    key = df.columns[0]
    given = spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet").select(key)
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in given.collect())


def test_every_operator_is_registered():
    found = (re.match(r"op(\d+)_", name) for name in entry.queries())
    numbers = sorted(int(m[1]) for m in found if m)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
