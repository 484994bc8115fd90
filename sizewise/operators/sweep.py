"""Lossy quantization sweeps over pixels, size estimates, and the lossy sensitivity probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.dims import LADDER
from sizewise.operators.pixels import luma
from sizewise.operators.quality import psnr, ssim_block

PROBE_QUALITY = 75


def step_of_quality(q: Column | int) -> Column:
    """Quantization step of a quality: 1 at 100, wider by one for each four points below."""
    q = F.lit(q) if isinstance(q, int) else q
    return (1 + F.floor((100 - q) / 4)).cast("int")


def quantized(c: str, step: Column) -> Column:
    """Channel value after quantization to multiples of the step."""
    return F.least(F.round(F.col(c) / step) * step, F.lit(255.0)).cast("int")


def expand_ladder(pixels: DataFrame, ladder: list[int]) -> DataFrame:
    """Each pixel once per rung, with its quantization step. The ladder is a short fixed list."""
    levels = F.array(*[F.lit(q) for q in ladder])
    return pixels.withColumn("q", F.explode(levels)).withColumn("step", step_of_quality(F.col("q")))


def quantized_pairs(pixels: DataFrame, ladder: list[int], weighted: bool = True) -> DataFrame:
    return pairs_of(expand_ladder(pixels, ladder), weighted)


def pairs_of(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """Pair table of pixels and their copies quantized by ``step``; both sides come from one row, so nothing is joined.

    ``weighted`` premultiplies colour by alpha on both sides, as in every measurement, so that what cannot be seen does
    not count.
    """

    def seen(value: Column) -> Column:
        return F.round(value * F.col("a") / 255.0).cast("int") if weighted else value

    step = F.col("step")
    sides = rows.select(
        "image_id", "q", "x", "y",
        *[seen(F.col(c)).alias(f"{c}1") for c in ("r", "g", "b")],
        *[seen(quantized(c, step)).alias(f"{c}2") for c in ("r", "g", "b")],
        F.col("a").alias("a1"),
        F.col("a").alias("a2"),
    )
    l1 = luma(F.col("r1"), F.col("g1"), F.col("b1"))
    l2 = luma(F.col("r2"), F.col("g2"), F.col("b2"))
    return sides.withColumn("l1", l1).withColumn("l2", l2)


def channel_histogram(pixels: DataFrame) -> DataFrame:
    """How often each value of a colour channel (0 red, 1 green, 2 blue) occurs with each alpha: (image_id, channel, value, a, n).

    Error and entropy of any quantization are sums over it, so pixels are read and shuffled once, combined before the shuffle, and not
    once per rung. An image has at most 3 x 65,536 rows, however large it is.
    """
    values = F.posexplode(F.array("r", "g", "b")).alias("channel", "value")
    return pixels.select("image_id", "a", values).groupBy("image_id", "channel", "value", "a").agg(F.count(F.lit(1)).alias("n"))


def expand_histogram(histogram: DataFrame, ladder: list[int]) -> DataFrame:
    levels = F.array(*[F.lit(q) for q in ladder])
    return histogram.withColumn("q", F.explode(levels)).withColumn("step", step_of_quality(F.col("q")))


def mse_of_histogram(rows: DataFrame) -> DataFrame:
    """Mean squared error over four channels and PSNR per (image_id, q), of a histogram with a ``q`` and a ``step``. Alpha is not quantized."""

    def seen(value: Column) -> Column:
        return F.round(value * F.col("a") / 255.0).cast("int")

    error = (seen(F.col("value")) - seen(quantized("value", F.col("step")))).cast("long")
    n_pixels = F.sum(F.when(F.col("channel") == 0, F.col("n")))
    mse = F.sum(error * error * F.col("n")).cast("double") / (4 * n_pixels)
    return rows.groupBy("image_id", "q").agg(mse.alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def quantize_sweep(pixels: DataFrame, ladder: list[int] | None = None) -> DataFrame:
    """Error and block similarity of every rung of every image: errors from the histogram, blocks from the pixels."""
    ladder = ladder or LADDER
    errors = mse_of_histogram(expand_histogram(channel_histogram(pixels), ladder))
    return errors.join(ssim_block(quantized_pairs(pixels, ladder), ["image_id", "q"]), ["image_id", "q"], "left")


def rung_entropy(pixels: DataFrame, ladder: list[int] | None = None) -> DataFrame:
    """Zero-order entropy in bits of the quantized colour channels: the size estimate without an encoder.

    With n the count of a value and N the number of pixels, a channel takes N log2 N - sum(n log2 n) bits.
    """
    return entropy_of_histogram(expand_histogram(channel_histogram(pixels), ladder or LADDER))


def entropy_of_histogram(rows: DataFrame) -> DataFrame:
    """The same for a histogram with a ``q`` and a ``step``."""
    value = F.round(F.col("value") / F.col("step")).cast("int").alias("level")
    counts = rows.groupBy("image_id", "q", "channel", value).agg(F.sum("n").alias("n"))
    channels = counts.groupBy("image_id", "q", "channel").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("weighted")
    )
    bits = F.greatest(F.sum(F.col("n") * F.log2("n") - F.col("weighted")), F.lit(0.0))
    return channels.groupBy("image_id", "q").agg(bits.alias("bits"), F.max("n").alias("n_pixels"))


def lossy_probe(pixels: DataFrame, q: int = PROBE_QUALITY) -> DataFrame:
    """How an image reacts to one fixed quantization: block similarity and bits per pixel."""
    pairs = quantized_pairs(pixels, [q], weighted=False)  # the probe looks at raw colour
    bits = rung_entropy(pixels, [q])
    return (
        bits.join(ssim_block(pairs, ["image_id", "q"]), ["image_id", "q"], "left")
        .select(
            "image_id",
            F.col("ssim").alias("lossy_probe_ssim"),
            (F.col("bits") / F.col("n_pixels")).alias("lossy_probe_bpp"),
        )
    )
