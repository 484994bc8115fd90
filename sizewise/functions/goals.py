"""Goals from identifiers or free text, and forced output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.functions.stages import unfused

# Goal identifiers accepted as they are.
GOAL_IDENTIFIERS = {
    "Lossless": "LOSSLESS",
    "Quality": "QUALITY",
    "Balanced": "BALANCED",
    "Compress": "MAXIMUM",
    "MaximumCompression": "MAXIMUM",
    "Web": "WEB",
    "ExtremeLightweight": "EXTREME",
}

# Substrings looked for in the accent-free lower-case text.
LIGHT_SIGNALS = [
    "ligero", "ligera", "light", "small", "peque", "comprim", "compress", "tiny", "minimo", "reduce", "reduc",
    "ahorra", "save bytes", "menor", "file size",
]
QUALITY_SIGNALS = [
    "calidad", "quality", "visual", "identico", "manten", "preserve", "preserv", "look", "sharp", "fidel", "igual",
    "no perder", "sin perder", "no cambie", "no camb", "casi igual",
]
LOSSLESS_SIGNALS = [
    "lossless", "sin perdida", "sin perder nada", "bit exact", "bit-exact", "exact", "perfect", "perfecto", "100%",
]
SPEED_SIGNALS = [
    "rapido", "fast", "quick", "speed", "web", "internet", "online", "browser", "navegador",
]
BALANCE_SIGNALS = [
    "balance", "equilibr", "balanced", "medium", "medio", "default", "por defecto",
]
EXTREME_WORDS = ["extreme", "extremo"]
ACCENTED, PLAIN = "áéíóúüñ", "aeiouun"

# Job modes and the goal each one runs.
JOB_MODES = {"Lossless": "LOSSLESS", "Quality": "QUALITY", "Compress": "MAXIMUM", "ExtremeLightweight": "EXTREME"}

# Names accepted as a forced format.
FORMAT_NAMES = {
    "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "webp": "WEBP", "avif": "AVIF", "gif": "GIF", "bmp": "BMP",
    "tif": "TIFF", "tiff": "TIFF",
}


def plain_text(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def count_signals(text: Column, signals: list[str]) -> Column:
    """How many of the signals occur in the text, each counted once."""
    hits = [F.contains(text, F.lit(s)).cast("int") for s in signals]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def goal_of_plain_text(plain: Column) -> Column:
    """Decide a goal from what a text asks for, the text being plain already (see ``plain_text``)."""
    light = count_signals(plain, LIGHT_SIGNALS) > 0
    quality = count_signals(plain, QUALITY_SIGNALS) > 0
    return (
        F.when(unfused(plain.isNull()), "BALANCED")
        .when(F.trim(plain) == "", "BALANCED")
        .when(count_signals(plain, BALANCE_SIGNALS) > 0, "BALANCED")
        .when(count_signals(plain, LOSSLESS_SIGNALS) > 0, "LOSSLESS")
        .when(quality & (light | (count_signals(plain, EXTREME_WORDS) > 0)), "EXTREME")
        .when(light, "MAXIMUM")
        .when(quality, "QUALITY")
        .when(count_signals(plain, SPEED_SIGNALS) > 0, "WEB")
        .otherwise("BALANCED")
    )


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def add_goal(requests: DataFrame, text: str, output: str = "goal", identifiers: bool = True) -> DataFrame:
    """Add the goal a text column asks for. An exact identifier wins; anything else is read as free text.

    The plain form of the text is a column of its own, so it is made once and not for every signal.
    """
    goal = goal_of_plain_text(F.col("_plain"))
    if identifiers:
        goal = F.coalesce(_lookup(GOAL_IDENTIFIERS, F.col(text)), goal)
    return requests.withColumn("_plain", plain_text(F.col(text))).withColumn(output, goal).drop("_plain")


def forced_format(text: Column) -> Column:
    """Format named by the user, with or without a leading dot; NULL when empty or unknown."""
    name = F.lower(F.regexp_replace(F.trim(text), r"^\.+", ""))
    return _lookup(FORMAT_NAMES, name)


def goal_of_mode(mode: Column) -> Column:
    """Goal of a job mode; lower-case spellings are accepted and unknown modes run as Quality."""
    names = dict(JOB_MODES)
    names.update({k.lower(): v for k, v in JOB_MODES.items()})
    return F.coalesce(_lookup(names, mode), F.lit("QUALITY"))
