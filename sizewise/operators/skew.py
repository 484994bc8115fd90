"""Ordered work inside groups without a single task per group.

Ordinary groups (the candidates of one image, the events of one job) are small, and one window per group is
the cheapest plan. A caller who knows of groups that hold a large share of all rows names their keys; those take
another exact way: positions are cut into fixed-width digits, so no window partition ever holds more than
``2 ** DIGIT_BITS`` distinct positions. Nothing is counted or collected to find out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 12
DIGIT_LEVELS = 4


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of the groups in ``hot`` or None. The parts share no key; together they are ``df``."""
    if hot is None:
        return df, None
    named = hot.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"_rows.{k}").eqNullSafe(F.col(f"_hot.{k}")) for k in keys])
    rows, large = df.alias("_rows"), named.alias("_hot")
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def per_group(
    df: DataFrame,
    keys: list[str],
    ordinary: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Apply the plain form to ordinary groups and the digit-wise form to those whose keys ``hot`` names.

    Both forms give the same rows; without ``hot`` there is one plan, whatever the size of the table.
    """
    small_rows, hot_rows = split_hot(df, keys, hot)
    done = ordinary(small_rows)
    return done if hot_rows is None else done.unionByName(large(hot_rows))


def prefix_max(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Largest ``value`` over strictly smaller positions of the same key, for one row per key and position.

    Positions are integers below 2**48 (larger ones only widen the topmost window). Returns the keys, the
    position and ``prefix``. At level n a window runs over the digits n of one key that share all higher
    digits, so it sees at most ``2 ** DIGIT_BITS`` rows; what lies before such a run comes from the next level.
    """
    level_rows = df.select(*keys, F.col(position).cast("long").alias("_pos"), F.col(value).alias("_best"))
    levels = []
    for level in range(DIGIT_LEVELS):
        top = level == DIGIT_LEVELS - 1
        run = keys if top else [*keys, "_up"]
        window = Window.partitionBy(*run).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        level_rows = level_rows.withColumn("_up", F.shiftright("_pos", DIGIT_BITS))
        levels.append(level_rows.withColumn("_before", F.max("_best").over(window)))
        level_rows = (
            level_rows.groupBy(*keys, "_up").agg(F.max("_best").alias("_best")).withColumnRenamed("_up", "_pos")
        )
    carried = levels[-1].select(*keys, "_pos", "_before")
    for lower in reversed(levels[:-1]):
        above = carried.select(*keys, F.col("_pos").alias("_up"), F.col("_before").alias("_above"))
        carried = lower.join(above, [*keys, "_up"]).select(
            *keys, "_pos", F.greatest("_before", "_above").alias("_before")
        )
    return carried.select(*keys, F.col("_pos").alias(position), F.col("_before").alias("prefix"))


def previous_value(
    df: DataFrame, keys: list[str], position: str, tie: str, value: str, output: str, hot: DataFrame | None = None
) -> DataFrame:
    """``value`` of the row just before, by position then tie, inside each key (a lag)."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, F.lag(value).over(Window.partitionBy(*keys).orderBy(position, tie)))

    def digits(rows: DataFrame) -> DataFrame:
        # Lag within one position; the first row there takes the last value of the closest earlier position.
        last = F.max(F.struct(position, tie, value))
        before = prefix_max(rows.groupBy(*keys, position).agg(last.alias("_last")), keys, position, "_last")
        inside = Window.partitionBy(*keys, position).orderBy(tie)
        return (
            rows.withColumn("_first", F.row_number().over(inside) == 1)
            .withColumn("_lag", F.lag(value).over(inside))
            .join(before, [*keys, position], "left")
            .withColumn(output, F.when(F.col("_first"), F.col(f"prefix.{value}")).otherwise(F.col("_lag")))
            .drop("_first", "_lag", "prefix")
        )

    return per_group(df, keys, plain, digits, hot)


def previous_by_bucket(df: DataFrame, keys: list[str], order: list[str], value: str, output: str, bucket: Column) -> DataFrame:
    """``value`` of the row just before in ``order`` inside each key, without a window over a whole key.

    ``bucket`` cuts the order into stretches: it must never fall along it. The last value of each stretch is an aggregate that combines
    before the shuffle; it is carried over the stretches of a key, whose number does not depend on how many rows they hold, to the next
    one that has rows. Inside a stretch it is an ordinary lag. A NULL value is a value.
    """
    rows = df.withColumn("_bucket", bucket)
    last = F.max(F.struct(*order, F.struct(value).alias("v")))["v"].alias("_last")
    ends = rows.groupBy(*keys, "_bucket").agg(last)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", F.lag("_last").over(along).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    lagged = rows.withColumn("_inside", F.lag(F.struct(value)).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(f"_rows.{k}").eqNullSafe(F.col(f"_ends.{k}")) for k in [*keys, "_bucket"]])
    joined = lagged.alias("_rows").join(carried.alias("_ends"), same)
    before = F.coalesce("_rows._inside", "_ends._carried")[value].alias(output)
    return joined.select(*[F.col(f"_rows.{c}") for c in df.columns], before)
