"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from sizewise.queries import QUERIES
from tools.compare import compare

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    status, detail = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir)
    assert status == "ok", detail


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert {"image_id", "outcome", "final_size"} <= set(df.columns)
    assert df.count() > 0


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) <= set(ORACLES) and set(QUERIES) <= set(entry.queries())
