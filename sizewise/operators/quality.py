"""Distortion between an original and an output, over pixel tables joined by position.

A pair table has the keys of the comparison, x, y, the four channels of both sides (``r1``..``a1``, ``r2``..``a2``)
and both lumas (``l1``, ``l2``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sizewise.operators.pixels import PIXEL_JOIN, TILE, luma, premultiplied

# Stabilizers, window and deviation of the structural similarity, block side of the fast form.
C1, C2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
WINDOW_HALF, SIGMA = 5, 1.5
BLOCK = 8
CHANNELS = ("r", "g", "b", "a")


def _side(pixels: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Premultiplied channels of one side: colours of invisible pixels must not count as errors."""
    channels = [premultiplied(c).alias(f"{c}{n}") for c in ("r", "g", "b")]
    rows = pixels.select(*keys, "x", "y", *channels, F.col("a").alias(f"a{n}"))
    return rows.withColumn(f"l{n}", luma(F.col(f"r{n}"), F.col(f"g{n}"), F.col(f"b{n}")))


def pair_pixels(original: DataFrame, output: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Join both sides by image and position; an inner join keeps the area both cover.

    ``keys`` name the comparison, for instance image and candidate; the original is joined by image alone.
    """
    keys = keys or ["image_id"]
    return _side(output, 2, keys).join(_side(original, 1, ["image_id"]).hint(PIXEL_JOIN), ["image_id", "x", "y"])


def mse_psnr(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean squared error over four channels, and PSNR, which is infinite for identical pixels."""
    keys = keys or ["image_id"]
    squared = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in CHANNELS)
    mse = F.sum(squared.cast("double")) / (4 * F.count(F.lit(1)))
    return pairs.groupBy(*keys).agg(mse.alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.try_divide(F.lit(65025.0), mse)))


def similarity(m1: Column, m2: Column, v1: Column, v2: Column, cov: Column) -> Column:
    """Structural similarity from two means, two variances and the covariance."""
    top = (2.0 * m1 * m2 + C1) * (2.0 * cov + C2)
    return top / ((m1 * m1 + m2 * m2 + C1) * (v1 + v2 + C2))


def _moments() -> list[Column]:
    return [
        F.avg("l1").alias("m1"), F.avg("l2").alias("m2"), F.var_pop("l1").alias("v1"), F.var_pop("l2").alias("v2"),
        F.covar_pop("l1", "l2").alias("cov"), F.count(F.lit(1)).alias("n"),
    ]


def _similarity_of_moments() -> Column:
    return similarity(F.col("m1"), F.col("m2"), F.col("v1"), F.col("v2"), F.col("cov"))


def ssim_block(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean similarity over whole 8 x 8 blocks; partial blocks at the border are left out."""
    keys = keys or ["image_id"]
    block = [F.floor(F.col("y") / BLOCK).alias("by"), F.floor(F.col("x") / BLOCK).alias("bx")]
    blocks = pairs.groupBy(*keys, *block).agg(*_moments()).where(F.col("n") == BLOCK * BLOCK)
    return blocks.groupBy(*keys).agg(
        F.avg(_similarity_of_moments()).alias("ssim"), F.count(F.lit(1)).alias("n_blocks")
    )


def ssim_global(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One similarity over all pixels, for images too small for a window."""
    keys = keys or ["image_id"]
    return pairs.groupBy(*keys).agg(*_moments()).select(*keys, _similarity_of_moments().alias("ssim"))


def _kernel() -> list[float]:
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-WINDOW_HALF, WINDOW_HALF + 1)]
    return [w / sum(weights) for w in weights]


def _weighted(df: DataFrame, line: list[str], position: str, names: list[str]) -> DataFrame:
    """Kernel-weighted sums along one axis. Positions without a whole window are dropped.

    Lines are cut into tiles; pixels within reach of a border are given to both tiles, so a window partition is
    never larger than a tile, and the pass is one shuffle.
    """
    p = F.col(position)
    tile, offset = F.floor(p / TILE).cast("int"), p % TILE
    copies = F.array_compact(
        F.array(
            tile,
            F.when((offset < WINDOW_HALF) & (tile > 0), tile - 1),
            F.when(offset >= TILE - WINDOW_HALF, tile + 1),
        )
    )
    rows = df.withColumn("_tile", F.explode(copies)).withColumn("_v", F.struct(*names))
    order = Window.partitionBy(*line, "_tile").orderBy(position)
    kernel = _kernel()
    shifted = [F.lag("_v", -d).over(order).alias(f"_w{d + WINDOW_HALF}") for d in range(-WINDOW_HALF, WINDOW_HALF + 1)]
    rows = rows.select(*line, position, "_tile", *shifted)
    whole = F.col("_w0").isNotNull() & F.col(f"_w{2 * WINDOW_HALF}").isNotNull()
    inside = F.floor(p / TILE).cast("int") == F.col("_tile")
    sums = [sum(kernel[i] * F.col(f"_w{i}.{n}") for i in range(len(kernel))).alias(n) for n in names]
    return rows.where(whole & inside).select(*line, position, *sums)


def ssim_gauss(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean similarity over 11 x 11 Gaussian windows at every position that has a whole window.

    The kernel is separable, so the five moments are weighted along rows first and along columns then. Images
    under 11 pixels on a side have no whole window and give no row; ``ssim_global`` serves those.
    """
    keys = keys or ["image_id"]
    names = ["m1", "m2", "s1", "s2", "s12"]
    l1, l2 = F.col("l1"), F.col("l2")
    moments = pairs.select(
        *keys, "x", "y", l1.alias("m1"), l2.alias("m2"), (l1 * l1).alias("s1"), (l2 * l2).alias("s2"), (l1 * l2).alias("s12")
    )
    along_rows = _weighted(moments, [*keys, "y"], "x", names)
    windows = _weighted(along_rows, [*keys, "x"], "y", names)
    zero = F.lit(0.0)
    value = similarity(
        F.col("m1"),
        F.col("m2"),
        F.greatest(F.col("s1") - F.col("m1") * F.col("m1"), zero),
        F.greatest(F.col("s2") - F.col("m2") * F.col("m2"), zero),
        F.col("s12") - F.col("m1") * F.col("m2"),
    )
    return windows.groupBy(*keys).agg(F.avg(value).alias("ssim"), F.count(F.lit(1)).alias("n_windows"))


def ssim(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The windowed similarity, or the global one for images without a whole window."""
    keys = keys or ["image_id"]
    windowed = ssim_gauss(pairs, keys)
    return (
        ssim_global(pairs, keys)
        .withColumnRenamed("ssim", "_global")
        .join(windowed, keys, "left")
        .select(*keys, F.coalesce("ssim", "_global").alias("ssim"))
    )


def evaluate(candidates: DataFrame, original: DataFrame, outputs: DataFrame) -> DataFrame:
    """Quality of each candidate (image_id, candidate_id, lossless, ...).

    Lossless candidates get the lossless marker without any comparison; only lossy outputs are joined with their
    original. A lossy output without error is marked lossless too, by measurement.
    """
    keys = ["image_id", "candidate_id"]
    lossy = candidates.where(~F.col("lossless")).select(*keys)
    pairs = pair_pixels(original, outputs.join(lossy, keys, "left_semi"), keys)
    measured = mse_psnr(pairs, keys).join(ssim(pairs, keys), keys)
    marker = F.col("lossless")
    return candidates.join(measured, keys, "left").select(
        *candidates.columns,
        F.when(marker, F.lit(0.0)).otherwise(F.col("mse")).alias("mse"),
        F.when(marker, F.lit(float("inf"))).otherwise(F.col("psnr")).alias("psnr"),
        F.when(marker, F.lit(1.0)).otherwise(F.col("ssim")).alias("ssim"),
        (marker | F.coalesce(F.col("mse") == 0, F.lit(False))).alias("is_lossless"),
    )


#: Scales of the perceptual measure, each of half the side of the one before, and its value for pictures without any likeness.
SCALES, DAMAGE_RANGE = 3, 100.0


def perceptual_damage(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Damage that the eye sees at several viewing distances: 0 for equal pictures, growing as the similarity of blocks falls.

    The similarity of 8 x 8 blocks, partial ones included, is taken of the lumas and of their means over 2 x 2 and 4 x 4 pixels. Each
    scale is an aggregate of the one before, a quarter of its rows.
    """
    keys = keys or ["image_id"]
    scale, parts = pairs.select(*keys, "x", "y", "l1", "l2"), []
    for s in range(SCALES):
        if s:
            half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("x", "y")]
            scale = scale.groupBy(*keys, *half).agg(F.avg("l1").alias("l1"), F.avg("l2").alias("l2"))
        block = [F.floor(F.col("y") / BLOCK).alias("by"), F.floor(F.col("x") / BLOCK).alias("bx")]
        parts.append(scale.groupBy(*keys, *block).agg(*_moments()).groupBy(*keys).agg(F.avg(_similarity_of_moments()).alias("s")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys).agg(F.round(DAMAGE_RANGE * (1.0 - F.avg("s")), 9).alias("damage"))
