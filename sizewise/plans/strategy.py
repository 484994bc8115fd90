"""Search-space assignment: which formats and quality ranges each image is tried with, under each goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.dims import GOAL_COLUMNS, goals_table, range_lookup
from sizewise.functions import profile as P
from sizewise.functions.scoring import photo_sensitive
from sizewise.functions.stages import unfused

CONSTRAINTS = [
    "force_format", "force_lossless", "max_width", "max_height", "strip_all_metadata", "preserve_color_profile",
    "time_limit_ms",
]


def block_reason(fmt: Column, animated: Column, alpha: Column, target: Column) -> Column:
    """Why a source cannot become a target format; NULL when it can."""
    return (
        F.when((fmt == "AVIF") & (target != "AVIF"), "source_not_decodable")
        .when(animated & (target != "GIF"), "animation_lost")
        .when(alpha & target.isin("JPEG", "BMP"), "transparency_lost")
    )


def can_convert(fmt: Column, animated: Column, alpha: Column, target: Column) -> Column:
    return block_reason(fmt, animated, alpha, target).isNull()


def target_size(
    width: Column,
    height: Column,
    target_width: Column,
    target_height: Column,
    percentage: Column,
    max_width: Column,
    max_height: Column,
    mode: Column,
) -> Column:
    """Resize plan as a struct of width and height; NULL when nothing was asked for.

    A percentage sets both sides, a maximum caps its side, a missing side follows by integer proportion, and
    Fit keeps the aspect ratio by the tighter side.
    """

    def by_share(side: Column) -> Column:
        share = F.greatest(percentage, F.lit(0.0))
        return F.when(percentage.isNotNull(), F.greatest(F.round(side * share / 100.0).cast("long"), F.lit(1)))

    # least() skips NULLs, so an unset side simply takes the other bound.
    w = F.least(F.coalesce(by_share(width), target_width), max_width).cast("long")
    h = F.least(F.coalesce(by_share(height), target_height), max_height).cast("long")
    aspect = width / F.greatest(height, F.lit(1))
    fit_by_width = aspect > w / h
    fit = F.when(
        fit_by_width, _size(w, F.greatest(F.round(w / aspect).cast("long"), F.lit(1)))
    ).otherwise(_size(F.greatest(F.round(h * aspect).cast("long"), F.lit(1)), h))
    derived_h = F.greatest(F.floor(height * w / F.greatest(width, F.lit(1))).cast("long"), F.lit(1))
    derived_w = F.greatest(F.floor(width * h / F.greatest(height, F.lit(1))).cast("long"), F.lit(1))
    return (
        F.when(w.isNull() & h.isNull(), None)
        .when(h.isNull(), _size(w, derived_h))
        .when(w.isNull(), _size(derived_w, h))
        .when(unfused(mode == "Fit"), fit)
        .otherwise(_size(w, h))
    )


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def assign_search_space(requests: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Strategy columns for profile rows that carry a goal and the user's constraints.

    A narrow plan: the goal is a broadcast lookup and everything else stays within the row, so nothing shuffles.
    """
    table = goals_table(requests.sparkSession) if goals is None else goals
    rows = requests.join(table.select(*GOAL_COLUMNS), "goal")
    fmt, animated, alpha = F.col("format"), F.col("is_animated"), F.col("has_alpha")
    forced = F.col("force_format")
    convertible = F.filter("preferred_formats", lambda f: can_convert(fmt, animated, alpha, f))
    own = F.when(fmt != "UNKNOWN", F.array(fmt)).otherwise(F.array().cast("array<string>"))
    union = F.array_distinct(F.concat(own, convertible))
    only_forced = F.when(
        (forced == fmt) | can_convert(fmt, animated, alpha, forced), F.array(forced)
    ).otherwise(F.array().cast("array<string>"))
    wanted = F.when(forced.isNull(), union).otherwise(only_forced)
    allowed = F.when(animated, F.filter(wanted, lambda f: f == "GIF")).otherwise(wanted)
    formats = F.slice(allowed, F.lit(1), F.greatest(F.col("max_candidates"), F.lit(1)))

    sensitive = photo_sensitive(F.col("lossy_probe_ssim"), P.photo_like(F.col("category")))
    include_lossy = F.col("allow_lossy") & ~F.col("force_lossless")

    def narrowed(f: Column) -> Column:
        r = range_lookup(f, F.col("goal"), F.col("photo_sensitive"))
        top = F.struct(r["high"].alias("low"), r["high"].alias("high"), F.lit(1).alias("step"))
        return F.when(P.is_very_large(F.col("file_size")), F.when(r.isNotNull(), top)).otherwise(r)

    ranges = F.transform("candidate_formats", lambda f: F.when(F.col("include_lossy"), narrowed(f)))
    exceeds = (F.col("width") > F.col("max_width")) | (F.col("height") > F.col("max_height"))
    lossless_required = F.col("force_lossless") | (F.col("goal") == "LOSSLESS")
    none = F.lit(None)
    resize = F.when(
        F.coalesce(exceeds, F.lit(False)) & ~lossless_required,
        target_size(
            F.col("width"), F.col("height"), none.cast("long"), none.cast("long"), none.cast("double"),
            F.col("max_width"), F.col("max_height"), F.lit("Fit"),
        ),
    )
    strip = F.col("strip_all_metadata")
    planned = (
        rows.withColumn("photo_sensitive", sensitive)
        .withColumn("include_lossy", include_lossy)
        .withColumn("candidate_formats", formats)
        .withColumn("quality_ranges", ranges)  # aligned with candidate_formats, NULL for none
        .withColumn("resize", resize)
        .withColumn("metadata_mode", F.when(strip, "RemoveAll").otherwise(F.col("goal_metadata_mode")))
        .withColumn("keep_color_profile", F.col("preserve_color_profile") & ~strip)
        .withColumn("time_budget_ms", F.coalesce("time_limit_ms", "max_processing_time_ms").cast("long"))
        .withColumn(
            "blocked_reason",
            F.when(
                forced.isNotNull() & (forced != fmt), block_reason(fmt, animated, alpha, forced)
            ),
        )
    )
    return planned.withColumn("rationale", rationale())


def rationale() -> Column:
    """One line on what will be tried and why."""
    return F.concat_ws(
        "; ",
        F.format_string("%s: %s %dx%d", F.col("goal"), F.col("format"), F.col("width"), F.col("height")),
        F.concat(F.lit("content "), F.col("category")),
        F.when(F.col("is_animated"), F.lit("animation limits formats to GIF")),
        F.when(F.col("has_alpha"), F.lit("transparency must survive")),
        F.concat(F.lit("formats "), F.concat_ws(",", "candidate_formats")),
        F.when(F.col("include_lossy"), F.lit("lossy allowed")).otherwise(F.lit("lossless only")),
        F.concat(F.lit("blocked "), F.col("force_format"), F.lit(" "), F.col("blocked_reason")),
    )
