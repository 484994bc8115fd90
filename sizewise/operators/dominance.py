"""Dominance (the size-quality front) inside each group, such as an image under one goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sizewise.functions.scoring import DOMINANCE_EPSILON
from sizewise.operators.skew import per_group, prefix_max


def _is_dominated(quality: Column, smaller: Column, same: Column) -> Column:
    """A smaller output is at least as good, or an equally small one is better. Equal peers both stay."""
    return F.coalesce(smaller >= quality - DOMINANCE_EPSILON, F.lit(False)) | F.coalesce(
        same > quality + DOMINANCE_EPSILON, F.lit(False)
    )


def mark_dominated_small(df: DataFrame, keys: list[str], size: str, quality: str, eligible: Column) -> DataFrame:
    """One window per group: the best quality over smaller sizes and over the same size."""
    by_size = Window.partitionBy(*keys).orderBy(size)
    q = F.when(eligible, F.col(quality))
    return (
        df.withColumn("_smaller", F.max(q).over(by_size.rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("_same", F.max(q).over(by_size.rangeBetween(0, 0)))
        .withColumn("dominated", eligible & _is_dominated(F.col(quality), F.col("_smaller"), F.col("_same")))
        .drop("_smaller", "_same")
    )


def mark_dominated_hot(df: DataFrame, keys: list[str], size: str, quality: str, eligible: Column) -> DataFrame:
    """The same flags for groups of any size: one row per size first, then digit-wise prefix maxima."""
    best = df.where(eligible).groupBy(*keys, size).agg(F.max(quality).alias("_same"))
    smaller = prefix_max(best, keys, size, "_same").withColumnRenamed("prefix", "_smaller")
    front = best.join(smaller, [*keys, size])
    return (
        df.join(front, [*keys, size], "left")
        .withColumn("dominated", eligible & _is_dominated(F.col(quality), F.col("_smaller"), F.col("_same")))
        .drop("_smaller", "_same")
    )


def mark_dominated(
    df: DataFrame, keys: list[str], size: str, quality: str, eligible: Column | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Add ``dominated``. Only eligible rows dominate or are dominated, those with the same ``keys``."""
    eligible = F.lit(True) if eligible is None else eligible
    return per_group(
        df,
        keys,
        lambda rows: mark_dominated_small(rows, keys, size, quality, eligible),
        lambda rows: mark_dominated_hot(rows, keys, size, quality, eligible),
        hot,
    )
