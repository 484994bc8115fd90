"""The numbered queries: thin steps from the given tables to the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.llm.common import table
from sizewise.llm.decontaminate import contamination
from sizewise.llm.embeddings import near_duplicate_vectors
from sizewise.llm.html_text import extract_main_text
from sizewise.llm.language import detect_language
from sizewise.llm.line_dedup import dedup_lines
from sizewise.llm.minhash import near_duplicates
from sizewise.llm.mixing import mix_to_weights
from sizewise.llm.phrases import mine_phrases
from sizewise.llm.spellings import group_spellings
from sizewise.llm.substrings import cut_repeats
from sizewise.llm.token_files import new_folder, read_tokens, write_tokens
from sizewise.llm.toxicity import judge_toxicity
from sizewise.llm.url_rules import judge_urls
from sizewise.session import inline_table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    found = detect_language(docs.select("doc_id", "text"), docs.where(~held_out), "text", "lang", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label columns as categories of the chain, the deciding one last."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge_toxicity(docs, toxicity_labels(spark, sf_dir), ["junk", "toxic"], "doc_id", "text")
    return found.select("doc_id", "p_junk", "p_toxic", F.col("rejected").alias("toxic"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, "doc_id", "text")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_to_weights(docs, category_col="source", id_col="doc_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = inline_table(spark, ["host", "path", "verdict"], URL_RULES)
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return mine_phrases(docs, "lang", "text").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_spellings(docs, "doc_id", "text").select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark)
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, "doc_id", "text")
    return read_tokens(spark, path, "doc_id").select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_minhash": op8_minhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_rules": op10_url_rules,
    "op11_phrases": op11_phrases,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}
