"""Ordered rules that reject a candidate before it is encoded, and the codec applicability check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.dims import TRIVIAL_BYTES

# The reason of each rule, in the order the rules are tried.
RULES = [
    "goal_no_lossy", "goal_no_lossless", "trivial_file", "no_alpha_format", "animated", "png_lossy",
    "jpeg_lossless_source", "icon_lossy", "text_low_q", "screenshot_avif_low_q", "dark_jpeg_low_q", "noisy_lossless",
    "saturated_jpeg_low_q", "flat_small_low_q", "ui_avif_low_q", "big_photo_png", "flat_jpeg_low_q", "tiny_lossy",
]


# Tags the rules look at.
RULE_TAGS = ["predominantly_dark", "noisy", "highly_saturated", "large_flat_areas", "text_or_ui"]


def tag_flags() -> list[Column]:
    """One boolean column per tag, for ``rejection_reason`` with ``flags``."""
    return [F.array_contains("characteristics", t).alias(f"is_{t}") for t in RULE_TAGS]


def rejection_reason(
    fmt: Column,
    quality: Column,
    lossless: Column,
    include_lossless: Column | None = None,
    flags: bool = False,
) -> Column:
    """Reason of the first rule that applies to a candidate of the current profile row; NULL to go on.

    A NULL quality never trips a rule on quality. With ``flags`` the tags are read from boolean columns.
    """
    lossy = ~lossless
    include_lossless = F.lit(True) if include_lossless is None else include_lossless
    size, pixels, cat = F.col("file_size"), F.col("pixel_count"), F.col("category")

    def tagged(tag: str) -> Column:
        return F.col(f"is_{tag}") if flags else F.array_contains("characteristics", tag)

    def below(limit: int) -> Column:
        return quality < limit

    jpeg, avif, png = fmt == "JPEG", fmt == "AVIF", fmt == "PNG"
    conditions = {
        "goal_no_lossy": ~F.col("include_lossy") & lossy,
        "goal_no_lossless": ~include_lossless & lossless,
        "trivial_file": (size < TRIVIAL_BYTES) & lossy,
        "no_alpha_format": F.col("has_alpha") & fmt.isin("JPEG", "BMP"),
        "animated": F.col("is_animated") & (fmt != "GIF"),
        "png_lossy": png & lossy,
        "jpeg_lossless_source": jpeg & lossless & (F.col("format") != "JPEG"),
        "icon_lossy": (pixels < 4096) & lossy & (cat == "Icon"),
        "text_low_q": (cat == "TextHeavy") & lossy & below(75),
        "screenshot_avif_low_q": (cat == "Screenshot") & avif & below(60),
        "dark_jpeg_low_q": tagged("predominantly_dark") & jpeg & below(80),
        "noisy_lossless": tagged("noisy") & lossless & (size > 200_000),
        "saturated_jpeg_low_q": tagged("highly_saturated") & jpeg & below(85),
        "flat_small_low_q": tagged("large_flat_areas") & lossy & (size < 120_000) & below(80),
        "ui_avif_low_q": tagged("text_or_ui") & avif & below(70),
        "big_photo_png": (cat == "Photograph") & (pixels > 5_000_000) & png & lossless,
        "flat_jpeg_low_q": tagged("large_flat_areas") & jpeg & below(95),
        "tiny_lossy": (pixels < 1024) & lossy & fmt.isin("AVIF", "WEBP", "JPEG"),
    }
    reason = None
    for name in RULES:
        reason = F.when(conditions[name], name) if reason is None else reason.when(conditions[name], name)
    return reason


def backend_applies(
    source_format: Column, has_alpha: Column, fmt: Column, quality: Column, lossless: Column
) -> Column:
    """Whether the codec of a format takes a candidate of this source."""
    jpeg = F.when(lossless, F.lit(False)).when(quality.isNull(), source_format == "JPEG").otherwise(~has_alpha)
    return (
        F.when(fmt == "JPEG", jpeg)
        .when(fmt == "AVIF", (source_format != "AVIF") & ~lossless)
        .when(fmt.isin("PNG", "WEBP"), F.lit(True))
        .when(fmt.isin("GIF", "BMP", "TIFF"), ~lossless)
        .otherwise(F.lit(False))
    )
