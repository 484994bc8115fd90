import math
from collections import Counter

from pyspark.sql import functions as F

from sizewise.llm.mixing import PART_MOST, mix_to_weights, mixing_rates, poisson_table


def test_shares_follow_the_weights(spark):
    rows = [(i, "hot" if i % 3 else ("a" if i % 2 else "b")) for i in range(6000)]
    images = spark.createDataFrame(rows, "image_id long, category string")
    weights = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("b", 1.0), ("none", 0.0)], "category string, weight double")
    got = mix_to_weights(images, weights).collect()
    shares = Counter(r.category for r in got)
    assert abs(len(got) - 6000) < 400
    assert abs(shares["a"] / len(got) - 0.5) < 0.05 and abs(shares["hot"] / len(got) - 0.25) < 0.05
    keys = [(r.image_id, r["copy"]) for r in got]
    assert len(set(keys)) == len(keys)


def test_partitioning_does_not_matter(spark):
    images = spark.createDataFrame([(i, f"c{i % 4}") for i in range(500)], "image_id long, category string")
    a, b = (sorted(mix_to_weights(x).collect()) for x in (images.repartition(1), images.repartition(7)))
    assert a == b


def test_large_rates_are_drawn_in_parts(spark):
    images = spark.createDataFrame([(1, "rare")] + [(i, "other") for i in range(2, 3000)], "image_id long, category string")
    weights = spark.createDataFrame([("rare", 1.0)], "category string, weight double")
    got = mix_to_weights(images, weights, rows=3000).collect()
    assert {r.category for r in got} == {"rare"} and abs(len(got) - 3000) < 300
    assert max(r["copy"] for r in got) > PART_MOST


def test_table_of_the_distribution(spark):
    table = spark.range(1).select(poisson_table(F.lit(2.5)).alias("t")).first().t
    total = 0.0
    for k in range(12):
        total += math.exp(-2.5) * 2.5**k / math.factorial(k)
        assert abs(table[k] - total) < 1e-12
    assert len(table) == PART_MOST + 1 and table[-1] == 1.0


def test_nulls_repeats_bad_weights_and_empty_tables(spark):
    rows = [(None, None, 1), (1, None, 2), (1, None, 2), (2, "a", 3)]
    images = spark.createDataFrame(rows, "image_id long, category string, copy int")
    got = mix_to_weights(images, rows=400).collect()
    assert {r.category for r in got} == {None, "a"} and abs(len(got) - 400) < 120
    twice = Counter(r["copy"] for r in got if r.image_id == 1)
    assert set(twice.values()) == {2}
    bad = spark.createDataFrame([("a", None), ("a", -1.0), (None, float("nan"))], "category string, weight double")
    assert mix_to_weights(images, bad).count() == 0
    assert mix_to_weights(images.limit(0)).count() == 0
    assert mixing_rates(images).where("rate > 0").count() == 2
