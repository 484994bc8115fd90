"""Column expressions over image profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.dims import TRIVIAL_BYTES, VERY_LARGE_BYTES

# Categories treated as photographic content.
PHOTO_CATEGORIES = ["Photograph", "HighlyDetailed", "Unknown"]


def category(
    complexity: Column, edges: Column, flat_runs: Column, dark: Column, pixels: Column, fmt: Column
) -> Column:
    """First matching content category; thresholds are fixed values and all comparisons are strict."""
    return (
        F.when((edges > 0.12) & (flat_runs > 20) & (complexity < 0.35), "Screenshot")
        .when((edges > 0.15) & (complexity < 0.25), "TextHeavy")
        .when(complexity < 0.05, "Gradient")
        .when((complexity < 0.15) & (flat_runs > 50), "Illustration")
        .when((complexity > 0.45) & (pixels > 500_000), "HighlyDetailed")
        .when((complexity > 0.30) & (pixels > 200_000), "GameTexture")
        .when((complexity > 0.20) & (pixels < 50_000), "Icon")
        .when((dark > 0.35) & (complexity > 0.15) & (pixels > 50_000), "Photograph")
        .when(pixels > 100_000, "Photograph")
        .when((complexity < 0.25) & (fmt == "PNG"), "TextHeavy")
        .otherwise("Unknown")
    )


def characteristics(
    flat_runs: Column,
    complexity: Column,
    any_alpha: Column,
    soft_alpha: Column,
    saturation: Column,
    dark: Column,
    flat_ratio: Column,
    noise: Column,
    edges: Column,
) -> Column:
    """Content tags in a fixed order."""
    tags = [
        ("flat_regions", flat_runs > 100),
        ("high_noise", complexity > 0.5),
        ("smooth", complexity < 0.1),
        ("sharp_edges", (complexity > 0.3) & (complexity < 0.5)),
        ("transparency", any_alpha),
        ("soft_alpha", soft_alpha),
        ("highly_saturated", saturation > 0.6),
        ("predominantly_dark", dark > 0.4),
        ("large_flat_areas", flat_ratio > 0.3),
        ("noisy", noise > 0.3),
        ("text_or_ui", edges > 0.15),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in tags]))


def photo_like(category_col: Column) -> Column:
    return category_col.isin(PHOTO_CATEGORIES)


def color_model(fmt: Column, is_gray: Column, has_alpha: Column) -> Column:
    return (
        F.when(fmt == "GIF", "Indexed")
        .when(is_gray & has_alpha, "GrayAlpha")
        .when(is_gray, "Gray")
        .when(has_alpha, "Rgba")
        .otherwise("Rgb")
    )


def pixel_count(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def bytes_per_pixel(file_size: Column, pixels: Column) -> Column:
    return file_size / F.greatest(pixels, F.lit(1))


def is_trivially_small(file_size: Column) -> Column:
    return file_size < TRIVIAL_BYTES


def is_very_large(file_size: Column) -> Column:
    return file_size > VERY_LARGE_BYTES


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / F.greatest(height, F.lit(1))


def summary_line(fmt: Column, width: Column, height: Column, cat: Column, complexity: Column) -> Column:
    return F.format_string("%s %dx%d, %s, complexity %.2f", fmt, width, height, cat, F.round(complexity, 2))


def adaptive_target(base: Column, noise: Column, complexity: Column, dark: Column, edges: Column) -> Column:
    """Perceptual target of a goal, relaxed by noise and tightened by smooth, dark or sharp content."""
    one = F.lit(1.0)
    factor = (
        F.when(noise > 0.4, F.lit(1.3)).otherwise(one)
        * F.when(complexity < 0.15, F.lit(0.8)).otherwise(one)
        * F.when(dark > 0.4, F.lit(0.85)).otherwise(one)
        * F.when(edges > 0.12, F.lit(0.75)).otherwise(one)
    )
    return F.when(base == 0.0, F.lit(0.0)).otherwise(F.least(F.greatest(base * factor, F.lit(0.5)), F.lit(3.0)))
