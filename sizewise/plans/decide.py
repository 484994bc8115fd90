"""From measured candidates to one decision per image and goal and a reason for every rejected candidate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sizewise.operators.dominance import mark_dominated_hot, mark_dominated_small
from sizewise.operators.score import add_score, gate_measurements
from sizewise.operators.skew import per_group

# What one decision is about: an image can be planned under several goals.
KEYS = ["image_id", "goal"]
# Columns of the winning candidate that travel with the decision.
WINNER = ["candidate_id", "format", "quality", "lossless", "iterative", "output_size", "score", "is_lossless",
          "ssim", "psnr"]


def _annotate_with(mark, rows: DataFrame, goals: DataFrame | None, max_output_size: int | None) -> DataFrame:
    accepted = F.col("reason").isNull()
    gated = gate_measurements(rows, goals, max_output_size)
    marked = mark(gated, KEYS, "output_size", "front_quality", accepted)
    return add_score(marked).withColumn("survives", accepted & ~F.col("dominated")).withColumn(
        "beats_original", F.col("survives") & (F.col("output_size") < F.col("original_size"))
    )


def annotate(
    measurements: DataFrame, goals: DataFrame | None = None, max_output_size: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Scored measurements with ``dominated``, ``survives`` and ``beats_original``."""
    return per_group(
        measurements,
        KEYS,
        lambda rows: _annotate_with(mark_dominated_small, rows, goals, max_output_size),
        lambda rows: _annotate_with(mark_dominated_hot, rows, goals, max_output_size),
        hot,
    )


def _first(order: list[Column], condition: Column) -> Column:
    """Payload of the first row in a total order among the rows that meet a condition."""
    payload = F.struct(*[F.col(c) for c in WINNER])
    return F.min(F.when(condition, F.struct(*order, payload.alias("row"))))["row"]


def choose(annotated: DataFrame, ranked: bool = False) -> DataFrame:
    """Aggregate annotated candidates to one decision per image and goal.

    With ``ranked`` the rows carry ``_rank`` among the candidates that beat the original, and the decision gets the
    runner-up: the best of them that is not the winner.
    """
    beats, lossless = F.col("beats_original"), F.col("lossless")
    by_rank = [(-F.col("score")).alias("o1"), F.col("output_size").alias("o2"), F.col("candidate_id").alias("o3")]
    by_size = [F.col("output_size").alias("o1"), (-F.col("score")).alias("o2"), F.col("candidate_id").alias("o3")]
    grouped = annotated.groupBy(*KEYS).agg(
        F.max("original_size").alias("original_size"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("success").alias("n_measured"),
        F.count_if("survives").alias("n_survivors"),
        _first(by_rank, beats).alias("best"),
        _first(by_size, beats & ~lossless).alias("small_lossy"),
        _first(by_size, beats & lossless).alias("small_lossless"),
        *([_first(by_rank, beats & (F.col("_rank") == 2)).alias("second")] if ranked else []),
    )
    prefer = F.col("small_lossless.output_size") <= F.col("small_lossy.output_size")
    chosen = F.when(F.coalesce(prefer, F.lit(False)), F.col("small_lossless")).otherwise(F.col("best"))
    outcome = (
        F.when(F.col("selected").isNotNull(), "selected")
        .when(F.col("n_measured") == 0, "all_failed")
        .when(F.col("n_survivors") == 0, "all_rejected")
        .otherwise("nothing_smaller")
    )
    decided = (
        grouped.withColumn("selected", chosen)
        .withColumn("outcome", outcome)
        .withColumn(
            "preference_fired",
            F.coalesce(F.col("selected.candidate_id") != F.col("best.candidate_id"), F.lit(False)),
        )
        .withColumn("final_size", F.coalesce("selected.output_size", "original_size"))
        .withColumn("kept_original", F.col("selected").isNull())
    )
    if ranked:
        runner_up = F.when(F.col("preference_fired"), F.col("best")).otherwise(F.col("second"))
        decided = decided.withColumn("runner_up", runner_up).drop("second")
    return decided.drop("best", "small_lossy", "small_lossless")


def decide(
    measurements: DataFrame,
    goals: DataFrame | None = None,
    max_output_size: int | None = None,
    runner_up: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per image and goal: the winner or the original, and why; with ``runner_up`` also the next best.

    The best-ranked survivor that beats the original is chosen, unless the smallest lossless survivor is no
    larger than the smallest lossy one. One shuffle on image and goal serves dominance and choice together. ``hot``
    names groups too large for one window; they are pre-aggregated on the map side.
    """

    def finish(annotated: DataFrame, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return choose(rank(annotated), ranked=True) if runner_up else choose(annotated)

    return per_group(
        measurements,
        KEYS,
        lambda rows: finish(_annotate_with(mark_dominated_small, rows, goals, max_output_size), _rank_small),
        lambda rows: finish(_annotate_with(mark_dominated_hot, rows, goals, max_output_size), _rank_hot),
        hot,
    )


def _rank_order() -> list[Column]:
    return [F.desc("beats_original"), F.desc("score"), F.asc("output_size"), F.asc("candidate_id")]


def _rank_small(annotated: DataFrame) -> DataFrame:
    """Rank by score, size and id among the candidates that beat the original; they come first in the window."""
    window = Window.partitionBy(*KEYS).orderBy(*_rank_order())
    return annotated.withColumn("_rank", F.row_number().over(window))


def _rank_hot(annotated: DataFrame) -> DataFrame:
    """The same for hot images, where only ranks 1 and 2 are wanted.

    ``row_number() <= 2`` becomes a top-2 per task before the shuffle, so a hot image sends few rows; the ranks are
    joined back by candidate.
    """
    window = Window.partitionBy(*KEYS).orderBy(*_rank_order())
    top = (
        annotated.where("beats_original").withColumn("_rank", F.row_number().over(window)).where("_rank <= 2")
        .select(*KEYS, "candidate_id", "_rank")
    )
    return annotated.join(top, [*KEYS, "candidate_id"], "left")


def rejections(annotated: DataFrame) -> DataFrame:
    """Every measured candidate that did not survive, with the stage and the reason."""
    dominated = F.col("dominated")
    return annotated.where(~F.col("survives")).select(
        "image_id",
        "candidate_id",
        "goal",
        "format",
        F.when(dominated, "front").otherwise(F.col("stage")).alias("stage"),
        F.when(dominated, "dominated").otherwise(F.col("reason")).alias("reason"),
    )
