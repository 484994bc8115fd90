"""Built-in dimension tables: formats, goals, quality ranges, presets.

All of them are constants of the domain (a few dozen rows in total), so they are inlined into plans as
local relations or literal maps and never read from storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.session import inline_table

# Formats in code order, with their extensions (canonical first) and codec capabilities
# (can_read, can_write, can_optimize, can_convert).
FORMATS = [
    ("PNG", 0, ["png"], True, True, True, True),
    ("JPEG", 1, ["jpg", "jpeg"], True, True, True, True),
    ("WEBP", 2, ["webp"], True, True, True, True),
    ("AVIF", 3, ["avif"], False, True, False, True),
    ("GIF", 4, ["gif"], True, True, False, True),
    ("BMP", 5, ["bmp"], True, True, False, True),
    ("TIFF", 6, ["tif", "tiff"], True, True, False, True),
]

# Goals. Columns: goal, quality, compression, speed and compatibility weights, minimum quality,
# lossy allowed, preferred formats (ordered), candidate cap, time budget (ms), perceptual target,
# runs the quality search, uses the perceptual gate, metadata mode.
GOAL_COLUMNS = [
    "goal", "quality_weight", "compression_weight", "speed_weight", "compatibility_weight",
    "min_quality_threshold", "allow_lossy", "preferred_formats", "max_candidates",
    "max_processing_time_ms", "perceptual_target", "searches", "perceptual_gate", "goal_metadata_mode",
]
GOALS = [
    ("LOSSLESS", 1.0, 0.2, 0.2, 0.5, 1.0, False, ["PNG", "WEBP"], 4, 30000, 0.0, False, False, "Keep"),
    ("QUALITY", 0.85, 0.30, 0.20, 0.40, 0.92, True, ["WEBP", "AVIF", "PNG"], 6, 60000, 0.75, True, False, "Keep"),
    ("BALANCED", 0.50, 0.70, 0.40, 0.40, 0.80, True, ["WEBP", "AVIF", "PNG", "JPEG"], 10, 60000, 1.5, False, False, "RemoveSafe"),
    ("MAXIMUM", 0.10, 1.0, 0.20, 0.30, 0.75, True, ["AVIF", "WEBP", "JPEG"], 12, 120000, 3.0, True, True, "RemoveSafe"),
    ("WEB", 0.40, 0.85, 0.70, 0.95, 0.75, True, ["WEBP", "JPEG", "PNG"], 5, 30000, 1.5, False, False, "RemoveSafe"),
    ("EXTREME", 0.40, 1.0, 0.10, 0.20, 0.90, True, ["WEBP", "AVIF", "JPEG", "PNG"], 16, 180000, 1.0, True, False, "RemoveSafe"),
]

# Quality ranges (format, goal, photo sensitive or NULL for either, low, high, step).
QUALITY_RANGES = [
    ("JPEG", "MAXIMUM", None, 60, 82, 7),
    ("JPEG", "WEB", None, 72, 88, 8),
    ("JPEG", "BALANCED", None, 78, 92, 7),
    ("JPEG", "QUALITY", None, 88, 96, 4),
    ("JPEG", "EXTREME", None, 65, 90, 5),
    ("WEBP", "MAXIMUM", None, 55, 80, 8),
    ("WEBP", "WEB", None, 72, 88, 8),
    ("WEBP", "BALANCED", None, 78, 92, 7),
    ("WEBP", "QUALITY", None, 88, 96, 4),
    ("WEBP", "EXTREME", None, 60, 90, 5),
    ("AVIF", "MAXIMUM", True, 40, 80, 10),
    ("AVIF", "MAXIMUM", False, 20, 60, 10),
    ("AVIF", "BALANCED", True, 80, 90, 5),
    ("AVIF", "BALANCED", False, 50, 70, 10),
    ("AVIF", "QUALITY", True, 90, 95, 5),
    ("AVIF", "QUALITY", False, 65, 82, 9),
    ("AVIF", "EXTREME", True, 70, 95, 8),
    ("AVIF", "EXTREME", False, 30, 65, 8),
]

# Encoding presets.
PRESET_COLUMNS = [
    "name", "kind", "jpeg_quality", "jpeg_progressive", "webp_quality", "webp_lossless", "avif_quality",
    "avif_alpha_quality", "png_optimization_level", "metadata_mode", "preserve_color_profile", "jpeg_chroma_444",
]
PRESETS = [
    ("Web", "Web", 85, True, 82, False, 60, 80, 4, "RemoveSafe", True, True),
    ("Lossless", "Lossless", 100, False, 100, True, 100, 100, 5, "Keep", True, True),
    ("Custom", "Custom", 85, True, 82, False, 60, 80, 4, "RemoveSafe", True, True),
]

# Descending search ladders and the size of the bisection gap.
LADDER = [95, 85, 75, 65, 55, 45, 35]
AVIF_LADDER = [80, 60, 40, 20]
BISECT_GAP = 5
BISECT_STEPS = 3

TRIVIAL_BYTES = 4096
VERY_LARGE_BYTES = 50 * 1024 * 1024
PHOTO_PROBE_SSIM = 0.955


def formats_table(spark: SparkSession) -> DataFrame:
    columns = ["format", "code", "extensions", "can_read", "can_write", "can_optimize", "can_convert"]
    return inline_table(spark, columns, FORMATS)


def goals_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, GOAL_COLUMNS, GOALS)


def quality_ranges_table(spark: SparkSession) -> DataFrame:
    """One row per format, goal and sensitivity; a range that holds for both sensitivities gives two rows."""
    rows = []
    for fmt, goal, sensitive, low, high, step in QUALITY_RANGES:
        for flag in ([True, False] if sensitive is None else [sensitive]):
            rows.append((fmt, goal, flag, low, high, step))
    return inline_table(spark, ["format", "goal", "photo_sensitive", "low", "high", "step"], rows)


def presets_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, PRESET_COLUMNS, PRESETS)


def extension_to_format() -> Column:
    """Literal map from a lower-case extension to its format."""
    pairs = []
    for fmt, _, extensions, *_ in FORMATS:
        for ext in extensions:
            pairs += [F.lit(ext), F.lit(fmt)]
    return F.create_map(*pairs)


def format_to_extension() -> Column:
    """Literal map from a format to its canonical extension."""
    pairs = []
    for fmt, _, extensions, *_ in FORMATS:
        pairs += [F.lit(fmt), F.lit(extensions[0])]
    return F.create_map(*pairs)


def range_lookup(fmt: Column, goal: Column, photo_sensitive: Column) -> Column:
    """Quality range of one format under one goal, NULL when the format has no ladder there."""
    pairs = []
    for f, g, sensitive, low, high, step in QUALITY_RANGES:
        value = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(step).alias("step"))
        for flag in ([True, False] if sensitive is None else [sensitive]):
            pairs += [F.lit(f"{f}|{g}|{str(flag).lower()}"), value]
    key = F.concat_ws("|", fmt, goal, photo_sensitive.cast("string"))
    return F.try_element_at(F.create_map(*pairs), key)
