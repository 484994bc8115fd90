"""Static cost and effort of a candidate: pure functions of its settings and the image profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizewise.functions.scoring import clamp

# Milliseconds per megapixel.
RATE_JPEG = 150.0
RATE_WEBP = 550.0
RATE_WEBP_LOSSLESS = 900.0
RATE_PNG = 350.0
RATE_PNG_DEEP = 4000.0
RATE_OTHER = 500.0
RATE_AVIF_UNPROBED = 2000.0
SEARCH_COST_FACTOR = 6


def effort(fmt: Column, quality: Column, lossless: Column, goal: Column) -> Column:
    """Relative effort 0..1; the fixed bases are per format."""
    base = (
        F.when(fmt == "AVIF", 0.9)
        .when(fmt == "WEBP", 0.6)
        .when((fmt == "PNG") & lossless & (goal == "MAXIMUM"), 0.85)
        .when((fmt == "PNG") & lossless, 0.5)
        .when(fmt == "PNG", 0.3)
        .when(fmt == "JPEG", 0.2)
        .when(fmt.isin("GIF", "BMP", "TIFF"), 0.3)
        .otherwise(0.5)
    )
    by_quality = F.coalesce(1.0 - quality / 200.0, F.lit(0.5))
    return clamp(base + by_quality * 0.2, 0.0, 1.0)


def avif_rate(quality: Column, bits_per_pixel: Column, has_alpha: Column) -> Column:
    """AVIF rate from the probe's bits per pixel, scaled by quality."""
    probed = (
        F.lit(1014.0)
        * F.pow(clamp(bits_per_pixel, 0.01, 8.0), F.lit(0.28))
        * F.when(has_alpha, 2.5).otherwise(1.0)
        * 1.8
    )
    base = F.coalesce(probed, F.lit(RATE_AVIF_UNPROBED))
    q = F.coalesce(quality, F.lit(75))
    return clamp(base * clamp(F.pow((q + 50.0) / 100.0, F.lit(5.8)), 1.0, 8.0), 400.0, 15000.0)


def static_cost_ms(
    fmt: Column,
    quality: Column,
    lossless: Column,
    searched: Column,
    pixels: Column,
    effort_col: Column,
    bits_per_pixel: Column,
    has_alpha: Column,
) -> Column:
    rate = (
        F.when(fmt == "AVIF", avif_rate(quality, bits_per_pixel, has_alpha))
        .when((fmt == "WEBP") & lossless, RATE_WEBP_LOSSLESS)
        .when(fmt == "WEBP", RATE_WEBP)
        .when((fmt == "PNG") & lossless & (effort_col >= 0.8), RATE_PNG_DEEP)
        .when(fmt == "PNG", RATE_PNG)
        .when(fmt == "JPEG", RATE_JPEG)
        .otherwise(RATE_OTHER)
    )
    by_quality = F.when(fmt == "AVIF", 1.0).otherwise(F.coalesce(0.9 + (100 - quality) / 500.0, F.lit(1.0)))
    megapixels = F.greatest(pixels / 1000000.0, F.lit(0.01))
    one_encode = F.floor(F.greatest(megapixels * rate * by_quality, F.lit(1.0))).cast("long")
    return one_encode * F.when(searched, SEARCH_COST_FACTOR).otherwise(1)
