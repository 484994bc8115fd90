"""Report columns: byte units, durations, percentages, quality digits, bands, basenames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units, smallest first.
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def format_bytes(value: Column) -> Column:
    """Binary units with one decimal; plain bytes below 1 KiB; the sign is kept in front."""
    size = F.abs(value)
    text = F.format_string("%d B", size)
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        scaled = F.bround(size / float(1024**power), 1)
        text = F.when(size >= 1024**power, F.format_string("%.1f " + unit, scaled)).otherwise(text)
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def format_duration(ms: Column) -> Column:
    """``N ms`` under a second, else ``M:SS`` or ``H:MM:SS``."""
    seconds = F.floor(ms / 1000).cast("long")
    hours = F.floor(seconds / 3600).cast("long")
    minutes = F.floor((seconds % 3600) / 60).cast("long")
    rest = seconds % 60
    return (
        F.when(ms < 1000, F.format_string("%d ms", ms))
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest))
        .otherwise(F.format_string("%d:%02d", minutes, rest))
    )


def format_percent(value: Column) -> Column:
    """One decimal; a small loss keeps its sign as -0.0%."""
    return F.concat(F.when(value < 0, "-").otherwise(""), F.format_string("%.1f%%", F.round(F.abs(value), 1)))


def format_quality(value: Column) -> Column:
    """Three digits for 0..1; a dash for NaN."""
    percent = F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")
    return F.when(F.isnan(value), F.lit("—")).otherwise(F.format_string("%03d", percent))


def reduction_band(percent: Column) -> Column:
    return (
        F.when(percent >= 40, "high").when(percent >= 15, "medium").when(percent > 0, "low").otherwise("none")
    )


def basename(path: Column) -> Column:
    """Last segment of a path with either slash; the path itself when it has no segment."""
    name = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.when(name == "", path).otherwise(name)
