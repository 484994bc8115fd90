"""What one task holds does not grow with the table."""

import pytest

from sizewise import datasets as D
from sizewise import session


@pytest.fixture
def tables(spark, tmp_path):
    """500 line items of 100 orders, one of them without its order, one without a key."""
    items = spark.range(500).selectExpr(
        "IF(id = 7, NULL, id % 100) AS l_orderkey", "id % 37 AS l_partkey", "id % 23 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber",
        "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id * 3.5 AS DOUBLE) AS l_extendedprice", "CAST(0.05 AS DOUBLE) AS l_discount",
        "CAST(0.02 AS DOUBLE) AS l_tax", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus",
        "TIMESTAMP'1995-01-01 00:00:00' AS l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(99).selectExpr("id AS o_orderkey", "CAST(id * 100.5 AS DOUBLE) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["decision_history", "decision_text", "encode_reuse_ratio", "reused_encodes"])
def test_measurements_are_dealt_by_their_number(spark, tables, monkeypatch, name):
    from sizewise.queries import QUERIES

    few = sorted(map(str, QUERIES[name](spark, tables).collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    assert D.measurements(spark, tables).rdd.getNumPartitions() == 25  # whatever the number of partitions of the session
    assert sorted(map(str, QUERIES[name](spark, tables).collect())) == few


def test_few_measurements_are_left_to_the_planner(spark, tables):
    assert session.tasks_for(spark, 500) is None
    assert session.tasks_for(spark, 216_000_000) == 864


def test_profiles_are_dealt_by_the_number_of_pixels(spark, tmp_path, monkeypatch):
    from sizewise.queries import QUERIES

    vectors = spark.range(40).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST(sin(id * 7 + i) / 3 AS FLOAT)) AS embedding")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    few = sorted(map(str, QUERIES["build_profiles"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    dealt = QUERIES["build_profiles"](spark, str(tmp_path))
    assert sorted(map(str, dealt.collect())) == few and len(few) == 10
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(image_id" in plan and ", 52), REPARTITION_BY_NUM" in plan  # 2,560 pixels, each in four sorts


def test_a_run_shuffles_only_what_the_store_holds(spark, tmp_path):
    from sizewise.sources import results

    rows = spark.range(60).selectExpr("id % 20 AS image_id", "CAST(id AS STRING) AS candidate_id", "CAST(id % 3 AS STRING) AS encode_key", "id AS size")
    keyed = rows.repartition(13, *results.KEY).persist()
    measure = lambda r: r.withColumn("shared", r["size"])
    first, counts = results.measure_once(keyed.where("image_id % 2 = 0"), f"{tmp_path}/store", "shared long", measure, tasks=13)
    assert counts == {"known": 0, "measured": 30}
    found, counts = results.measure_once(keyed, f"{tmp_path}/store", "shared long", measure, tasks=13)
    assert counts == {"known": 30, "measured": 30}
    assert found.where("shared IS NULL").count() == 0 and found.count() == 60
    plan = found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange ") <= 1
    keyed.unpersist()
