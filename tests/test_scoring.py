"""Both sides of every threshold of the score, and invariants of decisions."""

import math

import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise import dims
from sizewise.functions import scoring as S
from sizewise.operators.score import score_measurements
from sizewise.plans import decide as decisions

SCHEMA = (
    "image_id long, candidate_id string, goal string, original_size long, output_size long, format string, lossless boolean, "
    "iterative boolean, quality int, success boolean, ssim double, psnr double, mse double, perceptual double, "
    "estimated_cost_ms long, photo_like boolean, lossy_probe_ssim double"
)
BASE = dict(
    image_id=1, candidate_id="c", goal="BALANCED", original_size=1000, output_size=500, format="WEBP", lossless=False,
    iterative=False, quality=80, success=True, ssim=0.95, psnr=40.0, mse=5.0, perceptual=None, estimated_cost_ms=1000,
    photo_like=True, lossy_probe_ssim=None,
)


def measured(spark, *changes):
    return spark.createDataFrame([{**BASE, **c} for c in changes], SCHEMA)


def scored(spark, goals=None, **change):
    return score_measurements(measured(spark, change), goals).first()


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_compression_term_jumps_at_zero(spark):
    assert one(spark, S.compression_score(F.lit(0.0))) == pytest.approx(0.30)
    assert one(spark, S.compression_score(F.lit(0.01))) == pytest.approx(math.log10(1.09))
    assert one(spark, S.compression_score(F.lit(-0.5))) == pytest.approx(0.15)


@pytest.mark.parametrize("saved, factor", [(-0.3, 0.5), (0.0, 0.5), (0.05, 0.75), (0.0999, 0.9995), (0.10, 0.7), (0.15, 0.85), (0.20, 1.0)])
def test_marginal_savings(spark, saved, factor):
    assert one(spark, S.marginal_saving_penalty(F.lit(saved), F.lit(False))) == pytest.approx(factor)
    assert one(spark, S.marginal_saving_penalty(F.lit(saved), F.lit(True))) == 1.0


@pytest.mark.parametrize(
    "ssim, psnr, factor, value",
    [(1.0, math.inf, 1.0, 1.0), (0.9, 20.0, 1.0, 0.9 * 0.85), (0.9, 50.0, 1.0, 0.9), (0.9, 50.0, 0.9, 0.81), (1.0, 50.0, 1.05, 1.0),
     (math.nan, 40.0, 1.0, 0.0), (0.9, math.nan, 1.0, 0.0)],
)
def test_normalized_quality(spark, ssim, psnr, factor, value):
    assert one(spark, S.normalized_quality(F.lit(ssim), F.lit(psnr), F.lit(factor))) == pytest.approx(value)


@pytest.mark.parametrize("p, factor", [(1.5, 1.0), (1.51, 0.9), (0.5, 1.0), (0.49, 1.05), (None, 1.0)])
def test_perceptual_factor(spark, p, factor):
    assert one(spark, S.perceptual_factor(F.lit(p).cast("double"))) == factor


def test_estimates(spark):
    for fmt, q, sensitive, value in [("AVIF", 90, True, 0.93), ("AVIF", 89, True, 0.85), ("AVIF", 29, True, 0.62), ("AVIF", 30, False, 0.90),
                                     ("WEBP", 59, True, 0.78), ("JPEG", 95, True, 0.96), ("JPEG", 94, True, 0.92), ("JPEG", 64, True, 0.78),
                                     ("JPEG", None, True, 0.88), ("GIF", 50, True, 0.85), ("AVIF", 100, False, 0.99)]:
        got = one(spark, S.estimated_quality(F.lit(fmt), F.lit(q).cast("int"), F.lit(sensitive)))
        assert got == value, (fmt, q, sensitive)


def test_gates(spark):
    assert scored(spark, ssim=0.75, psnr=50.0).reason == "below_quality"
    assert scored(spark, ssim=0.80, psnr=50.0).reason is None
    assert scored(spark, ssim=0.84, psnr=50.0, iterative=True).reason == "below_quality"
    assert scored(spark, ssim=0.86, psnr=20.0, iterative=True).reason is None
    assert scored(spark, goal="MAXIMUM", ssim=0.54).reason == "below_quality"
    assert scored(spark, goal="MAXIMUM", ssim=0.56, perceptual=3.0).reason is None
    assert scored(spark, goal="MAXIMUM", ssim=0.56, perceptual=3.01).reason == "perceptual_limit"
    assert scored(spark, goal="LOSSLESS", lossless=True, ssim=None).reason is None
    assert scored(spark, success=False).stage == "failed"
    assert scored(spark, ssim=0.5, mse=0.0).reason is None


def test_unknown_and_invalid_goals_reject_everything(spark):
    assert scored(spark, goal="NOBODY").reason == "invalid_goal"
    good = dims.goals_table(spark).where("goal = 'WEB'").withColumn("goal", F.lit("MINE"))
    assert scored(spark, good, goal="MINE").reason is None
    for column, value in [("quality_weight", -0.1), ("speed_weight", math.inf), ("compression_weight", math.nan), ("min_quality_threshold", 1.1)]:
        assert scored(spark, good.withColumn(column, F.lit(value)), goal="MINE").reason == "invalid_goal", column


def test_score_by_hand(spark):
    row = scored(spark)
    quality = 0.95 * (0.85 + 0.15 * 20 / 30)
    expected = (quality * 0.5 + math.log10(1 + 9 * 0.5) * 0.7 + 0.8 * 0.4) / 1.6 + 1.0 * 0.4 * 0.05
    assert row.score == pytest.approx(expected)


def test_lossless_is_preferred_at_equal_size(spark):
    rows = measured(
        spark, dict(candidate_id="lossy", output_size=400, ssim=0.999, estimated_cost_ms=1),
        dict(candidate_id="exact", output_size=400, lossless=True, format="PNG", ssim=None, estimated_cost_ms=90000),
    )
    # The lossy one is dominated at the same size, so nothing has to be preferred.
    row = decisions.decide(rows).first()
    assert row.selected.candidate_id == "exact" and row.n_survivors == 1


def test_output_not_smaller_keeps_the_original(spark):
    row = decisions.decide(measured(spark, dict(output_size=1000))).first()
    assert (row.outcome, row.kept_original, row.final_size) == ("nothing_smaller", True, 1000)
    assert decisions.decide(measured(spark, dict(success=False))).first().outcome == "all_failed"
    assert decisions.decide(measured(spark, dict(ssim=0.1))).first().outcome == "all_rejected"


def test_every_image_and_candidate_ends_in_one_place(spark, sf_dir):
    m = D.measurements(spark, sf_dir)
    annotated = decisions.annotate(m)
    decided = decisions.decide(m)
    assert decided.count() == m.select("image_id").distinct().count()
    assert decided.where("NOT kept_original AND final_size >= original_size").count() == 0
    rejected = decisions.rejections(annotated)
    survivors = annotated.where("survives").select("image_id", "candidate_id")
    assert rejected.count() + survivors.count() == m.count()
    assert rejected.select("image_id", "candidate_id").exceptAll(m.select("image_id", "candidate_id")).count() == 0
    assert rejected.join(survivors, ["image_id", "candidate_id"], "left_semi").count() == 0


def test_a_dominated_candidate_changes_nothing(spark, sf_dir):
    m = D.measurements(spark, sf_dir).where("ssim IS NOT NULL AND NOT lossless")
    worse = m.withColumn("output_size", F.col("output_size") + 1).withColumn("candidate_id", F.concat("candidate_id", F.lit("x")))
    columns = ["image_id", "outcome", "final_size", "selected.candidate_id"]
    before = decisions.decide(m).select(*columns)
    after = decisions.decide(m.unionByName(worse)).select(*columns)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
