"""Profile builder: files and their pixels to one profile per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.functions import profile as P
from sizewise.operators.pixels import MAX_PIXELS, neighbour_stats, pixel_stats, preview
from sizewise.operators.sweep import lossy_probe
from sizewise.session import deal


def build_profiles(files: DataFrame, pixels: DataFrame, tasks: int | None = None) -> DataFrame:
    """Profiles of all files (image_id, format, width, height, file_size).

    Images within the pixel guard are measured on a preview. Files over it, of unknown size or without decoded pixels
    keep the default measures; ``error`` names the first two and is NULL otherwise. With ``tasks`` pixels are dealt by image to that
    many, in which all measures are taken; without, the session's number of partitions says how many pixels a task sorts.
    """
    count = P.pixel_count(F.col("width"), F.col("height"))
    error = F.when(count.isNull(), "unknown_size").when(count > MAX_PIXELS, "too_many_pixels")
    files = files.withColumn("error", error)
    usable = files.where("error IS NULL")
    # One preview feeds three aggregates; each needs its own grouping, and none reads more than four channels.
    sizes = usable.select("image_id", "width", "height")
    small = preview(deal(pixels, tasks, "image_id"), deal(sizes, tasks, "image_id"))
    stats, neighbours, probe = pixel_stats(small), neighbour_stats(small), lossy_probe(small)
    rows = (
        files.join(stats, "image_id", "left").join(neighbours, "image_id", "left").join(probe, "image_id", "left")
    )
    measured = F.col("error").isNull() & (F.col("width") >= 2) & (F.col("height") >= 2)

    def measure(name: str, default):
        return F.when(measured, F.coalesce(F.col(name), F.lit(default))).otherwise(F.lit(default)).alias(name)

    side = F.greatest("width", "height")
    preview_rows = F.greatest(F.round(F.col("height") * F.least(F.lit(1.0), 256 / side)), F.lit(1.0))
    base = rows.select(
        "image_id", "format", "width", "height", "file_size", "error",
        *[
            measure(n, 0.0)
            for n in (
                "mean_luma", "contrast", "mean_saturation", "dark_region_ratio", "bright_region_ratio",
                "edge_density", "complexity", "compressibility",
            )
        ],
        measure("flat_run_count", 0),
        F.coalesce("has_alpha", F.lit(False)).alias("any_alpha"),
        F.coalesce("soft_alpha", F.lit(False)).alias("soft_alpha"),
        F.coalesce("is_gray", F.lit(False)).alias("is_gray"),
        "lossy_probe_ssim", "lossy_probe_bpp",
        preview_rows.alias("_rows"),
    )
    flat_ratio = F.col("flat_run_count") / F.greatest(2.0 * F.col("_rows"), F.lit(1.0))
    derived = (
        base.withColumn("flat_region_ratio", flat_ratio)
        .withColumn(
            "noise_estimate", F.least(F.col("complexity") * F.col("flat_region_ratio") * 2.0, F.lit(1.0))
        )
        .withColumn("pixel_count", P.pixel_count(F.col("width"), F.col("height")))
        .withColumn("color_model", P.color_model(F.col("format"), F.col("is_gray"), F.col("any_alpha")))
        .withColumn("has_alpha", F.col("color_model").isin("Rgba", "GrayAlpha"))
        .withColumn("is_animated", F.col("format") == "GIF")
    )
    category = P.category(
        F.col("complexity"), F.col("edge_density"), F.col("flat_run_count"), F.col("dark_region_ratio"),
        F.col("pixel_count"), F.col("format"),
    )
    tags = P.characteristics(
        F.col("flat_run_count"), F.col("complexity"), F.col("any_alpha"), F.col("soft_alpha") & F.col("has_alpha"),
        F.col("mean_saturation"), F.col("dark_region_ratio"), F.col("flat_region_ratio"), F.col("noise_estimate"),
        F.col("edge_density"),
    )
    return derived.withColumn("category", category).withColumn("characteristics", tags).drop("_rows", "is_gray")
