"""Candidate generation: strategy rows expanded to candidates, pruned by rules, capped by priority.

One image has at most a few dozen candidates, so the whole expansion, the pruning and the cap happen on arrays
inside the row. Nothing is shuffled, however many images there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.functions import cost
from sizewise.functions.profile import is_trivially_small, photo_like
from sizewise.functions.rules import RULE_TAGS, backend_applies, rejection_reason, tag_flags

ANCHOR_LEVELS = 3


def quality_levels(r: Column) -> Column:
    """Ascending levels of a range; the upper end is always included once."""
    return F.array_union(F.sequence(r["low"], r["high"], r["step"]), F.array(r["high"]))


def _candidate(kind: str, fmt: Column, quality: Column, lossless: bool, dominated_ahead: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        fmt.alias("target"),
        quality.cast("int").alias("quality"),
        F.lit(lossless).alias("lossless"),
        dominated_ahead.alias("same_decade"),
    )


def _of_format(entry: Column) -> Column:
    """All candidates of one format and its quality range, in order of priority."""
    fmt, r = entry["candidate_formats"], entry["quality_ranges"]
    no_q, no = F.lit(None), F.lit(False)
    lossy = F.col("include_lossy")
    searched = (
        F.col("searches")
        & lossy
        & ((fmt.isin("JPEG", "WEBP") & ~F.col("has_alpha")) | ((fmt == "AVIF") & (F.col("goal") == "MAXIMUM")))
    )
    source = ~F.col("searches") & lossy & (fmt == "JPEG") & (F.col("format") == "JPEG")
    fixed = F.array_compact(
        F.array(
            F.when(searched, _candidate("search", fmt, no_q, False, no)),
            F.when(source, _candidate("source", fmt, no_q, False, no)),
            F.when(fmt.isin("PNG", "WEBP"), _candidate("lossless", fmt, no_q, True, no)),
        )
    )
    # Levels ascend, so a decade was seen before exactly when the level below q lies in the same decade.
    step = F.greatest(r["step"], F.lit(1))

    def level(q: Column) -> Column:
        below = r["low"] + F.floor((q - 1 - r["low"]) / step) * step
        repeated = (fmt == "AVIF") & (q > r["low"]) & (F.floor(q / 10) == F.floor(below / 10))
        return _candidate("level", fmt, q, False, repeated)

    every = quality_levels(r)
    levels = F.when(searched, F.slice(every, 1, ANCHOR_LEVELS)).otherwise(every)
    ladder = F.transform(F.coalesce(levels, F.array().cast("array<int>")), level)
    return F.concat(fixed, ladder)


def _computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fix the value of columns that array functions read for every element.

    The optimizer merges neighbouring projections, which would move the expressions behind these columns into the
    array functions and evaluate them once per element. A one-element explode stands in between.
    """
    others = [c for c in df.columns if c not in columns]
    fixed = df.select(*others, F.explode(F.array(F.struct(*columns))).alias("_once"))
    return fixed.select(*others, "_once.*")


def generate_candidates(strategies: DataFrame) -> DataFrame:
    """One row per candidate with its position, label, effort, cost and, if rejected, the reason.

    ``position`` counts from 0 in order of generation. ``reason`` is NULL for candidates to be encoded.
    """
    flags = [f"is_{t}" for t in RULE_TAGS]
    strategies = strategies.select("*", *tag_flags())
    read_per_element = [
        "format", "goal", "file_size", "pixel_count", "category", "has_alpha", "is_animated", *flags,
        "include_lossy", "searches", "max_candidates", "candidate_formats", "quality_ranges",
    ]
    strategies = _computed_once(strategies, read_per_element)
    entries = F.arrays_zip("candidate_formats", "quality_ranges")
    generated = strategies.withColumn("_all", F.flatten(F.transform(entries, _of_format)))
    judged = generated.withColumn(
        "_all",
        F.transform(
            "_all",
            lambda c, i: F.struct(
                i.alias("position"),
                c.alias("c"),
                F.when(c["same_decade"], "same_decade")
                .otherwise(rejection_reason(c["target"], c["quality"], c["lossless"], flags=True))
                .alias("reason"),
            ),
        ),
    )
    accepted = judged.withColumn("_ok", F.filter("_all", lambda c: c["reason"].isNull()))
    # The last position that fits under the cap; later accepted candidates are dropped for priority.
    # A cap of 0 or less leaves none, no cap leaves all.
    cap = F.col("max_candidates")
    last = F.when(cap <= 0, F.lit(-1)).otherwise(F.get(F.col("_ok"), cap - 1)["position"])
    rows = accepted.withColumn("_last", last).select("*", F.explode("_all").alias("_c")).drop("_all", "_ok", *flags)
    target, quality, lossless = F.col("target"), F.col("quality"), F.col("lossless")
    searched = F.col("kind") == "search"
    return (
        rows.select(
            "*",
            F.col("_c.position").alias("position"),
            F.col("_c.c.kind").alias("kind"),
            F.col("_c.c.target").alias("target"),
            F.col("_c.c.quality").alias("quality"),
            F.col("_c.c.lossless").alias("lossless"),
            F.coalesce(
                F.col("_c.reason"), F.when(F.col("_c.position") > F.col("_last"), "over_cap")
            ).alias("reason"),
        )
        .drop("_c", "_last")
        .withColumn("iterative", searched)
        .withColumn("label", candidate_label(F.col("kind"), target, quality))
        .withColumn("effort", cost.effort(target, quality, lossless, F.col("goal")))
        .withColumn(
            "estimated_cost_ms",
            cost.static_cost_ms(
                target, quality, lossless, searched, F.col("pixel_count"), F.col("effort"),
                F.col("lossy_probe_bpp"), F.col("has_alpha"),
            ),
        )
        .withColumn("photo_like", photo_like(F.col("category")))
        .withColumn("applies", backend_applies(F.col("format"), F.col("has_alpha"), target, quality, lossless))
    )


def candidate_label(kind: Column, fmt: Column, quality: Column) -> Column:
    return F.when(kind == "level", F.concat(fmt, F.lit(" q"), quality.cast("string"))).otherwise(F.concat_ws(" ", fmt, kind))


def first_occurrences(candidates: DataFrame, group: list[str], position: str) -> DataFrame:
    """For candidate lists from elsewhere: keep the first of each (format, quality, lossless) per group.

    An aggregate, so repeats combine on the map side. NULL qualities are one value.
    """
    keys = [*group, "format", "quality", "lossless"]
    return candidates.groupBy(*keys).agg(
        F.min(position).alias(position), F.count(F.lit(1)).alias("n_occurrences")
    )


def split_trivial(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles worth planning, and kept originals for files too small to bother with."""
    small = is_trivially_small(F.col("file_size"))
    kept = profiles.where(small).select(
        "image_id", F.col("file_size").alias("original_size"), F.col("file_size").alias("final_size"),
        F.lit("trivially_small").alias("outcome"), F.lit(True).alias("kept_original"),
    )
    return profiles.where(~small), kept
