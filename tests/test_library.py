"""The chain from files and pixels to decisions and rejections."""

import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise import dims
from sizewise.functions.profile import adaptive_target
from sizewise.operators import rates
from sizewise.operators.quality import perceptual_damage
from sizewise.operators.score import MEASUREMENT_COLUMNS
from sizewise.operators.sweep import step_of_quality
from sizewise.plans import library, strategy
from sizewise.plans.decide import annotate, choose, rejections
from sizewise.plans.profiles import build_profiles
from sizewise.session import cut_lineage
from tests.test_ladder import by_hand_on

GOALS = ["QUALITY", "MAXIMUM"]


@pytest.fixture(scope="module")
def chain(spark, sf_dir):
    few = "image_id < 12"
    pixels = cut_lineage(D.library_pixels(spark, sf_dir).where(few))
    requests = cut_lineage(D.with_constraints(build_profiles(D.library_files(spark, sf_dir).where(few), pixels)))
    strategies = strategy.assign_search_space(requests.withColumn("goal", F.explode(F.array(*[F.lit(g) for g in GOALS]))))
    planned = cut_lineage(library.plan_library(strategies))
    measured = cut_lineage(library.measure_candidates(planned.where("stage IS NULL"), pixels))
    return pixels, planned, measured


def test_every_candidate_is_decided_or_rejected(chain):
    _, planned, measured = chain
    annotated = annotate(measured)
    decisions = choose(annotated).collect()
    accepted = planned.where("stage IS NULL")
    assert len(decisions) == accepted.select("image_id", "goal").distinct().count() and {r.goal for r in decisions} == set(GOALS)
    assert rejections(annotated).count() + sum(r.n_survivors for r in decisions) == accepted.count() == measured.count()
    assert sum(r.outcome == "all_failed" for r in decisions) <= 0.05 * len(decisions)
    assert len({r.selected.format for r in decisions if r.selected}) > 1


def test_searches_against_a_loop(spark, chain):
    """Every rung of every image is measured, and each search walks down by hand."""
    pixels, planned, measured = chain
    searches = planned.where("stage IS NULL AND iterative").select(
        "image_id", "goal", "target", "noise_estimate", "complexity", "dark_region_ratio", "edge_density").collect()
    qualities = spark.range(20, 96).select(F.col("id").cast("int").alias("q")).withColumn("step", step_of_quality(F.col("q")))
    ids = pixels.select("image_id").distinct()
    steps = qualities.select("step").distinct()
    bits = rates.lossy_bits(rates.block_coefficients(pixels), ids.crossJoin(steps).withColumn("format", F.explode(F.array(*map(F.lit, rates.LOSSY_FORMATS)))))
    damage = perceptual_damage(library.distortions(pixels, ids.crossJoin(steps)), ["image_id", "q"])
    size_of = {(r.image_id, r.format, r.step): 64 + -(-r.bits // 8) for r in bits.collect()}
    damage_of = {(r.image_id, r.q): r.damage for r in damage.collect()}
    base = {g[0]: g[10] for g in dims.GOALS}
    got = {(r.image_id, r.goal, r.format): (r.quality, r.output_size, r.perceptual) for r in measured.where("iterative").collect()}
    assert len(got) == len(searches) > 20
    for s in searches:
        row = spark.range(1).select(adaptive_target(*[F.lit(v) for v in (base[s.goal], s.noise_estimate, s.complexity, s.dark_region_ratio, s.edge_density)]))
        limit = row.first()[0]
        table = {q: (size_of[s.image_id, s.target, 1 + (100 - q) // 4], damage_of[s.image_id, 1 + (100 - q) // 4]) for q in range(20, 96)}
        q, _, _ = by_hand_on(table, limit, dims.AVIF_LADDER if s.target == "AVIF" else dims.LADDER)
        assert got[s.image_id, s.goal, s.target] == (q, *table[q])
    assert len({q for q, _, _ in got.values()}) > 4


def test_measurements_fit_the_scorer_and_failures_stay_rows(chain):
    pixels, planned, measured = chain
    assert set(MEASUREMENT_COLUMNS) <= set(measured.columns)
    candidates = planned.where("stage IS NULL AND goal = 'MAXIMUM'")
    rows = library.measure_candidates(candidates, pixels.where("image_id % 2 = 0")).collect()
    assert len(rows) == candidates.count() == len({(r.image_id, r.goal, r.candidate_id) for r in rows})
    assert {r.error for r in rows if r.image_id % 2} <= {"no_pixels", "not_applicable"} and not any(r.iterative for r in rows if r.image_id % 2)
    assert all(r.success == (r.error is None) and r.success == (r.output_size is not None) for r in rows)
    assert all(r.mse == 0 for r in rows if r.lossless and r.success)
    # The gate of this goal asks for the damage of every lossy candidate, and causes are kept as reasons.
    assert all(r.perceptual is not None for r in rows if r.success and r.mse > 0)
    sizes = {}
    for r in rows:
        if r.success and not r.lossless:
            sizes.setdefault((r.image_id, r.quality), set()).add((r.format, r.output_size))
    assert any(len({s for _, s in v}) > 1 for v in sizes.values())
