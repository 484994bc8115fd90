"""Quality ladder search against a step-by-step loop, and with a codec that measures on demand."""

import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise.operators.ladder import ladder_of_format, ladder_scan, ladder_search, search_frontier, search_with_codec

LADDER = [95, 85, 75, 65, 55, 45, 35]


def by_hand(rungs, target):
    return by_hand_on(rungs, target, LADDER)


def by_hand_on(rungs, target, ladder):
    tried, lowest, bad = [], None, None
    for q in ladder:
        tried.append(q)
        if rungs[q][1] < target:
            lowest = q
        else:
            bad = q
            break
    if bad is not None and lowest is not None and lowest > bad + 5:
        lo, hi = bad, lowest
        for _ in range(3):
            mid = (lo + hi) // 2
            if mid in (lo, hi):
                break
            tried.append(mid)
            if rungs[mid][1] < target:
                hi = mid
            else:
                lo = mid
    passing = [(rungs[q][0], rungs[q][1], q) for q in tried if rungs[q][1] < target]
    best = min(passing) if passing else None
    return (best[2] if best else bad, best is not None, len(tried))


def rung_table(spark, sf_dir):
    rows = D.rungs(spark, sf_dir)
    table = {}
    for r in rows.collect():
        table.setdefault(r.image_id, {})[r.q] = (r["size"], r.damage)
    return rows, table


def test_search_against_a_loop(spark, sf_dir):
    rows, table = rung_table(spark, sf_dir)
    for target in (0.9, 1.5, 2.4):
        got = {r.image_id: (r.q, r.converged, r.n_tried) for r in ladder_search(rows, target).collect()}
        assert got == {i: by_hand(t, target) for i, t in table.items()}


def test_scan_stops_at_the_first_miss(spark):
    rows = [(1, q, 100, 0.1 if q != 65 else 9.0) for q in LADDER]
    row = ladder_scan(spark.createDataFrame(rows, "image_id long, q int, size long, damage double"), 1.0).first()
    assert (row.first_miss, row.lowest_pass, row.n_reached) == (65, 75, 4)


def test_boundary_is_strict(spark):
    rows = [(1, q, q, 1.0) for q in range(20, 96)]
    row = ladder_search(spark.createDataFrame(rows, "image_id long, q int, size long, damage double"), 1.0).first()
    assert (row.converged, row.q, row.n_tried) == (False, 95, 1)


def test_targets_per_image(spark, sf_dir):
    rows, table = rung_table(spark, sf_dir)
    rows = rows.withColumn("t", F.when(F.col("image_id") % 2 == 0, 1.5).otherwise(2.4))
    got = {r.image_id: (r.q, r.converged, r.n_tried) for r in ladder_search(rows, F.col("t")).collect()}
    assert got == {i: by_hand(t, 1.5 if i % 2 == 0 else 2.4) for i, t in table.items()}


def test_repeated_rungs_change_nothing(spark, sf_dir):
    rows, _ = rung_table(spark, sf_dir)
    once, twice = ladder_search(rows, 1.5), ladder_search(rows.unionAll(rows), 1.5)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_search_with_a_codec_measures_only_what_it_needs(spark, sf_dir):
    rows, table = rung_table(spark, sf_dir)
    asked = []

    def measure(wanted):
        asked.append(wanted.count())
        return wanted.join(rows, ["image_id", "q"])

    images = rows.select("image_id").distinct()
    got = {r.image_id: (r.q, r.converged, r.n_tried) for r in search_with_codec(images, measure, 1.5).collect()}
    expected = {i: by_hand(t, 1.5) for i, t in table.items()}
    assert got == expected
    assert sum(asked) == sum(n for _, _, n in expected.values())


@pytest.mark.parametrize("ahead", [1, 3])
def test_frontier_of_searches_with_ladders_and_targets_of_their_own(spark, sf_dir, ahead):
    rows, table = rung_table(spark, sf_dir)
    formats = {"AVIF": [80, 60, 40, 20], "JPEG": LADDER}
    searches = rows.select("image_id").distinct().crossJoin(
        spark.createDataFrame([("a", "JPEG", 1.5), ("b", "JPEG", 2.4), ("b", "AVIF", 0.9), ("c", "AVIF", 1.5)], "goal string, format string, target double"))
    searches = searches.withColumn("ladder", ladder_of_format(F.col("format")))
    asked = []

    def measure(wanted):
        asked.extend((r.image_id, r.format, r.q) for r in wanted.collect())
        return wanted.join(rows, ["image_id", "q"])

    got = search_frontier(searches, measure, ("image_id", "goal", "format"), ("image_id", "format"), ahead).collect()
    for goal, fmt, target in (("a", "JPEG", 1.5), ("b", "JPEG", 2.4), ("b", "AVIF", 0.9), ("c", "AVIF", 1.5)):
        found = {r.image_id: (r.q, r.converged, r.n_tried) for r in got if (r.goal, r.format) == (goal, fmt)}
        assert found == {i: by_hand_on(t, target, formats[fmt]) for i, t in table.items()}
    assert len(asked) == len(set(asked))  # nothing is measured twice
    assert all(r["size"] == table[r.image_id][r.q][0] for r in got)


def test_frontier_without_measurements_or_searches(spark):
    searches = spark.createDataFrame([(1, 1.0)], "image_id long, target double").withColumn("ladder", F.array(F.lit(9), F.lit(5)))
    nothing = lambda wanted: wanted.where("false").selectExpr("image_id", "q", "0L AS size", "0D AS damage")
    row = search_frontier(searches, nothing, ("image_id",), ("image_id",)).first()
    assert (row.q, row.converged, row.n_tried) == (None, False, 0)
    assert search_frontier(searches.limit(0), nothing, ("image_id",), ("image_id",)).count() == 0


def test_format_rungs_never_broadcast_lists_of_rungs(spark, tmp_path):
    keys = spark.range(1, 400).select(F.col("id").alias("p_partkey")).unionByName(spark.createDataFrame([(7,)], "p_partkey long"))
    keys.write.parquet(f"{tmp_path}/part.parquet")
    rows = D.format_rungs(spark, str(tmp_path))
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert above.count("Generate") == 2 and "Generate" not in below
    counts = {r.image_id: r["count"] for r in rows.groupBy("image_id").count().collect()}
    assert counts.pop(7) == 4 * 2 * 76 and set(counts.values()) == {2 * 76}  # a key that comes twice meets itself
    plain = D.rungs(spark, str(tmp_path)).where("image_id <> 7")
    assert rows.where("image_id <> 7 AND format = 'JPEG'").select(*plain.columns).exceptAll(plain).isEmpty()
