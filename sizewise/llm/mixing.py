"""Mixing the parts of a library to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

SEED = "mix-1"
#: A larger mean is drawn as a sum of equal independent parts of at most this mean.
PART_MEAN = 16.0
#: Counts of one part: the chance of more, at PART_MEAN, is below one in 10 ** 35.
PART_MOST = 96
#: Categories that one broadcast of rates may hold, at most; beyond that the join is left to Spark.
BROADCAST_CATEGORIES = 50_000


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mixing_rates(images: DataFrame, weights: DataFrame | None = None, category_col: str = "category",
                 rows: int | None = None) -> DataFrame:
    """The mean number of copies of a row of each category: ``category``, ``n``, ``rate``.

    Target shares are the given weights over their sum, or equal ones. ``rows`` is the size aimed at, by default the
    number of rows in categories with a weight. A category without a weight, or with one that is null, negative or no
    number, gets rate 0; null is a category like any other.
    """
    counts = images.groupBy(F.col(category_col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("category").alias("c")).agg(F.sum("weight").alias("weight"))
        weighed = counts.join(given, F.col("category").eqNullSafe(F.col("c")), "left").drop("c")
    good = F.when((F.col("weight") > 0) & ~F.isnan(F.col("weight").cast("double")), F.col("weight").cast("double"))
    weighed = weighed.withColumn("weight", F.coalesce(good, F.lit(0.0)))
    sums = weighed.where("weight > 0").agg(F.sum("weight").alias("w"), F.sum("n").alias("rows")).first()  # one row
    total, aim = (sums["w"] or 1.0), (rows if rows is not None else sums["rows"] or 0)
    return weighed.select("category", "n", (F.lit(float(aim)) * (F.col("weight") / F.lit(float(total))) / F.col("n")
                                            ).alias("rate"))


def poisson_table(mean: Column) -> Column:
    """The distribution function of a Poisson count at 0, 1, ... PART_MOST as an array; the last entry is 1."""
    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(PART_MOST)), start,
        lambda acc, k: F.struct((acc["term"] * mean / k).alias("term"), (acc["sum"] + acc["term"]).alias("sum"),
                                F.concat(acc["out"], F.array(acc["sum"] + acc["term"])).alias("out")))
    return F.concat(steps["out"], F.array(F.lit(1.0)))


def mix_to_weights(images: DataFrame, weights: DataFrame | None = None, category_col: str = "category",
                   id_col: str = "image_id", seed: str = SEED, rows: int | None = None) -> DataFrame:
    """Replicates the rows of a library so that its categories have the given shares, in a global random order.

    Runs on profiled images (``image_id``, ``category``) as on any table with an id and a category. The number of copies
    of a row is a Poisson count whose mean is the repetition rate of its category, found by inverting the distribution
    at a uniform number hashed from seed and id; equal input gives equal output, however it is partitioned. Returns all
    columns, ``copy`` (1, 2, ..., unique within a row) and ``shuffle_key``, in random order.

    A mean above PART_MEAN is drawn in parts, each exploded by itself, so that no array grows with the rate. The copies
    are dealt by the hash of row and copy: a category with a third of all rows is spread like the others.

    Rows that repeat an id get equal counts. A null id is hashed as an empty string. Columns named ``copy`` or
    ``shuffle_key`` are replaced. An empty table, or weights that fit no category, give an empty result.
    """
    rates = mixing_rates(images, weights, category_col, rows).where("rate > 0")
    parts = F.ceil(F.col("rate") / PART_MEAN).cast("long")
    rates = rates.select(F.col("category").alias("_category"), parts.alias("_parts"),
                         poisson_table(F.col("rate") / parts).alias("_table"))
    few = rates.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES
    drawn = images.drop("copy", "shuffle_key")
    names = drawn.columns
    drawn = drawn.join(F.broadcast(rates) if few else rates, F.col(category_col).eqNullSafe(F.col("_category")))
    # Two steps, since one array of all parts of a row could be large.
    thousand = F.lit(1000)
    drawn = drawn.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_parts") - 1) / thousand))))
    last = F.least(F.col("_parts") - 1, F.col("_block") * thousand + 999)
    drawn = drawn.withColumn("_part", F.explode(F.sequence(F.col("_block") * thousand, last)))
    u = _uniform(F.lit(seed), F.col(id_col), F.col("_part"))
    count = F.size(F.filter("_table", lambda c: c <= u))
    drawn = drawn.withColumn("_count", count).where("_count > 0")
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    copy = (F.col("_part") * PART_MOST + F.col("_k")).cast("long")
    text = F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       copy.cast("string"))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    out = drawn.select(*names, copy.alias("copy"), key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")
