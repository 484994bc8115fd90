"""Scoring: measurements joined with their goal, gated, scored.

The expressions are kept small on purpose, see ``functions.stages``: everything that depends on the goal alone is
computed on the small goal table before the join, and the gates are compiled apart from the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.dims import FORMATS, goals_table
from sizewise.functions import scoring as S
from sizewise.functions.stages import unfused

# What scoring needs to know about a measured candidate.
MEASUREMENT_COLUMNS = [
    "image_id", "candidate_id", "goal", "original_size", "output_size", "format", "lossless", "iterative",
    "quality", "success", "ssim", "psnr", "mse", "perceptual", "estimated_cost_ms", "photo_like",
    "lossy_probe_ssim",
]
GOAL_TERMS = [
    "goal_valid", "gate", "floor", "search_floor", "gate_limit", "wq", "wc", "ws", "wsum", "preference",
]


def goal_terms(goals: DataFrame) -> DataFrame:
    """One row per goal and format with every term of the score that does not depend on the candidate."""
    formats = F.array(*[F.lit(f[0]) for f in FORMATS], F.lit("UNKNOWN"))
    total = F.col("quality_weight") + F.col("compression_weight") + F.col("speed_weight")
    gate = F.col("perceptual_gate")
    return goals.select("*", F.explode(formats).alias("format")).select(
        "goal",
        "format",
        F.when(S.valid_weights(), True).alias("goal_valid"),  # NULL for an invalid goal, as for an unknown one
        F.col("perceptual_gate").alias("gate"),
        F.when(gate, S.PERCEPTUAL_FLOOR_SSIM).otherwise(F.col("min_quality_threshold")).alias("floor"),
        F.when(gate, S.PERCEPTUAL_FLOOR_SSIM).otherwise(S.SEARCH_FLOOR_SSIM).alias("search_floor"),
        F.col("perceptual_target").alias("gate_limit"),
        F.col("quality_weight").alias("wq"),
        F.col("compression_weight").alias("wc"),
        F.col("speed_weight").alias("ws"),
        F.when(total > 0, total).otherwise(F.lit(1.0)).alias("wsum"),
        (
            S.format_preference(F.col("format"), F.col("preferred_formats")) * F.col("compatibility_weight") * 0.05
        ).alias("preference"),
    )


def gate_measurements(
    measurements: DataFrame, goals: DataFrame | None = None, max_output_size: int | None = None
) -> DataFrame:
    """Join the goal, add the qualities and the verdict of the gates.

    ``stage`` and ``reason`` are NULL for accepted rows; a failed row has its ``error``, where there is such a column, as reason. ``front_quality`` is the quality used for dominance,
    which ignores how the candidate was found. User-defined goals are rows of ``goals``; how that side is joined
    is left to Spark, since only the built-in table has a known size.
    """
    table = goal_terms(goals_table(measurements.sparkSession) if goals is None else goals)
    rows = measurements.join(table, ["goal", "format"], "left")
    lossless, ssim, perceptual = F.col("is_lossless"), F.col("ssim"), F.col("perceptual")
    sensitive = S.photo_sensitive(F.col("lossy_probe_ssim"), F.col("photo_like"))
    estimate = S.estimated_quality(F.col("format"), F.col("quality"), sensitive)
    bounded, factor = F.col("_ssim"), F.col("_factor")
    rows = (
        rows.withColumn("is_lossless", F.col("lossless") | F.coalesce(F.col("mse") == 0.0, F.lit(False)))
        # NaN compares as larger than any number, so it is kept apart from the upper bound.
        .withColumn("_ssim", F.when(ssim < 0.0, 0.0).when((ssim > 1.0) & ~F.isnan(ssim), 1.0).otherwise(ssim))
        .withColumn("_factor", S.perceptual_factor(perceptual))
        .withColumn(
            "front_quality",
            F.when(lossless, F.lit(1.0))
            .when(ssim.isNull(), estimate)
            .otherwise(S.normalized_quality(bounded, F.col("psnr"), factor)),
        )
    )
    found_by_search = ~lossless & F.col("iterative") & ssim.isNotNull()
    rows = rows.withColumn(
        "quality_score",
        F.when(found_by_search, S.search_quality(bounded, factor)).otherwise(F.col("front_quality")),
    ).drop("_ssim", "_factor")
    structural = F.when(F.col("gate"), F.coalesce(ssim, "quality_score")).otherwise(F.col("quality_score"))
    threshold = F.when(F.col("iterative"), F.col("search_floor")).otherwise(F.col("floor"))
    limit = F.when(F.col("iterative"), S.SEARCH_PERCEPTUAL_LIMIT).otherwise(F.col("gate_limit"))
    cause = F.coalesce("error", F.lit("backend_error")) if "error" in measurements.columns else F.lit("backend_error")
    reason = F.when(unfused(~F.col("success")), cause)
    if max_output_size is not None:
        reason = reason.when(F.col("output_size") > max_output_size, "output_too_large")
    reason = (
        reason.when(F.col("goal_valid").isNull(), "invalid_goal")
        .when(lossless, None)
        .when(structural < threshold - S.QUALITY_TOLERANCE, "below_quality")
        .when(F.col("gate") & (perceptual > limit + S.PERCEPTUAL_TOLERANCE), "perceptual_limit")
    )
    unusable = ~F.col("success")
    if max_output_size is not None:
        unusable = unusable | (F.col("output_size") > max_output_size)
    stage = F.when(unusable, "failed").when(F.col("reason").isNotNull(), "score")
    return rows.withColumn("reason", reason).withColumn("stage", stage)


def add_score(gated: DataFrame) -> DataFrame:
    """Score of the accepted rows, NULL for the others; the goal's terms are dropped."""
    score = S.final_score(
        F.col("quality_score"), F.col("percentage_saved"), F.col("estimated_cost_ms"), F.col("is_lossless")
    )
    saved = S.percentage_saved(F.col("original_size"), F.col("output_size"))
    return (
        gated.withColumn("percentage_saved", saved)
        .withColumn("score", F.when(F.col("reason").isNull(), score))
        .drop(*GOAL_TERMS)
    )


def score_measurements(
    measurements: DataFrame, goals: DataFrame | None = None, max_output_size: int | None = None
) -> DataFrame:
    return add_score(gate_measurements(measurements, goals, max_output_size))

