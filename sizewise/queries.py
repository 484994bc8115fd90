"""Queries over the provided tables, by name. Each takes a session and a folder of parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sizewise import datasets as D
from sizewise import dims
from sizewise.functions import goals as goal_text
from sizewise.functions import headers, paths, text
from sizewise.functions import profile as P
from sizewise.functions import scoring as S
from sizewise.operators import compare, ladder, quality, rates, sweep
from sizewise.operators import pixels as pixel_ops
from sizewise.operators.dominance import mark_dominated
from sizewise.operators.score import score_measurements
from sizewise.plans import candidates, jobs, library, reports, strategy
from sizewise.plans import decide as decisions
from sizewise.plans import profiles as profile_plan
from sizewise.session import checkpoint_dir, cut_lineage, deal, spread, tasks_for, written
from sizewise.sources import files, records, results
from sizewise.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name.split(".")[-1])


# Decisions ------------------------------------------------------------------------------------------------


@query
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which encoding wins for each image, or is the original kept?"""
    return decisions.decide(D.measurements(spark, sf_dir)).select(
        "image_id", "goal", "outcome", "kept_original", "preference_fired", "original_size", "final_size",
        "selected.candidate_id", "selected.format", "selected.quality", "selected.lossless", _r("selected.score"),
        "n_candidates", "n_measured", "n_survivors",
    )


@query
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_measurements(D.measurements(spark, sf_dir)).select(
        "image_id", "candidate_id", "stage", "reason", _r("quality_score"), _r("percentage_saved"), _r("score")
    )


@query
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates that no other accepted candidate of the image dominates."""
    return (
        decisions.annotate(D.measurements(spark, sf_dir))
        .where("survives")
        .select("image_id", "candidate_id", "output_size", _r("front_quality"))
    )


@query
def pareto_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of size and raw SSIM over everything measured."""
    rows = D.measurements(spark, sf_dir).where(F.col("ssim").isNotNull())
    return (
        mark_dominated(rows, ["image_id"], "output_size", "ssim")
        .where(~F.col("dominated"))
        .select("image_id", "candidate_id", "output_size", _r("ssim"))
    )


@query
def result_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.measurements(spark, sf_dir).where("success")
    original, output, ms = F.col("original_size"), F.col("output_size"), F.col("estimated_cost_ms")
    rows = m.select("image_id", "candidate_id", "output_size", *[c.alias(n) for n, c in S.result_metrics(original, output, ms).items()], "estimated_cost_ms")
    return rows.select(
        "image_id", "candidate_id", "bytes_saved", _r("percentage_saved"), _r("compression_ratio"), _r("throughput_mbps"),
        text.format_bytes(F.col("output_size")).alias("size_text"),
        text.format_duration(F.col("estimated_cost_ms")).alias("duration_text"),
        text.format_percent(F.col("percentage_saved")).alias("percent_text"),
        text.reduction_band(F.col("percentage_saved")).alias("band"),
    )


@query
def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.measurements(spark, sf_dir).where(F.col("ssim").isNotNull())
    return m.groupBy(text.format_quality(F.col("ssim")).alias("quality_text")).agg(F.count(F.lit(1)).alias("n"))


@query
def score_custom_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-defined goals: one per customer segment, with weights from its accounts; a negative weight is invalid."""
    weight = F.round(F.avg("c_acctbal") / 10000.0, 4)
    goals = (
        D.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(weight.alias("w"), F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("CUSTOM "), "c_mktsegment").alias("goal"), F.col("w").alias("quality_weight"),
            F.lit(0.6).alias("compression_weight"),
            F.when(F.col("c_mktsegment") == "MACHINERY", -0.1).otherwise(0.3).alias("speed_weight"),
            F.lit(0.4).alias("compatibility_weight"), F.lit(0.7).alias("min_quality_threshold"),
            F.lit(True).alias("allow_lossy"), F.array(F.lit("JPEG"), F.lit("PNG")).alias("preferred_formats"),
            F.lit(8).alias("max_candidates"), F.lit(60000).alias("max_processing_time_ms"),
            F.lit(1.5).alias("perceptual_target"), F.lit(False).alias("searches"), F.lit(False).alias("perceptual_gate"),
            F.lit("RemoveSafe").alias("goal_metadata_mode"),
        )
    )
    owners = D.read(spark, sf_dir, "orders").join(D.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    owners = owners.select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("CUSTOM "), "c_mktsegment").alias("goal"))
    m = D.measurements(spark, sf_dir).drop("goal").join(owners, "image_id")
    return score_measurements(m, goals).select("image_id", "candidate_id", "goal", "stage", "reason", _r("score"))


@query
def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(D.measurements(spark, sf_dir), runner_up=True).where("runner_up IS NOT NULL")
    return decided.select("image_id", "runner_up.candidate_id", "runner_up.output_size", _r("runner_up.score"))


@query
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = decisions.annotate(D.measurements(spark, sf_dir), max_output_size=3_000_000)
    return decisions.rejections(annotated).select("image_id", "candidate_id", "stage", "reason")


@query
def rejection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = decisions.annotate(D.measurements(spark, sf_dir))
    return reports.rejection_rollup(decisions.rejections(annotated))


@query
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = decisions.annotate(D.measurements(spark, sf_dir))
    return reports.rejection_counts(decisions.rejections(annotated))


@query
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.measurements(spark, sf_dir)
    totals = reports.batch_totals(decisions.decide(m))
    elapsed = reports.batch_elapsed(m, F.col("estimated_cost_ms"))
    return totals.select("*", elapsed.scalar().alias("total_processing_ms"))


@query
def outcome_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_partition(decisions.decide(D.measurements(spark, sf_dir)))


@query
def decision_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.explanations(decisions.decide(D.measurements(spark, sf_dir), runner_up=True))


@query
def decision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(D.measurements(spark, sf_dir))
    at, took = F.lit("2024-01-01T00:00:00Z"), F.col("n_candidates") * 100
    auto = reports.decision_history(decided, "auto", at, took)
    return auto.unionByName(reports.decision_history(decided, "queue", at, took))


@query
def metric_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose costly perceptual metric has to be computed."""
    m = D.measurements(spark, sf_dir)
    gated = m.withColumn("gate", F.col("goal") == "MAXIMUM").withColumn("is_lossless", F.col("lossless"))
    needed = S.needs_perceptual_metric(F.col("is_lossless"), F.col("ssim"), F.col("perceptual"), F.col("gate"))
    return gated.where(needed).select("image_id", "candidate_id", _r("ssim"))


@query
def encode_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.encodes_to_run(reports.encode_key(D.encode_settings(spark, sf_dir)))


@query
def encode_reuse_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = reports.encodes_to_run(reports.encode_key(D.encode_settings(spark, sf_dir)))
    return reports.reuse_ratio(runs).select("hits", "misses", _r("hit_ratio"))


@query
def share_encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the size measured once for its encode key."""
    keyed = reports.encode_key(D.encode_settings(spark, sf_dir))
    measured = keyed.groupBy("image_id", "encode_key").agg(
        F.min_by("output_size", "candidate_id").alias("shared_size")
    )
    return reports.share_encodes(keyed, measured).select("image_id", "candidate_id", "encode_key", "shared_size")


@query
def reused_encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one store of results: the second measures only keys that the first did not have."""
    keyed = reports.encode_key(D.encode_settings(spark, sf_dir)).select("image_id", "candidate_id", "encode_key", "output_size")
    tasks = tasks_for(spark, D.read(spark, sf_dir, "lineitem").count())
    keyed = deal(keyed, tasks, *results.KEY).persist(StorageLevel.DISK_ONLY)  # read again and again
    store = f"{_scratch(spark)}/results"
    measure = lambda rows: rows.withColumn("shared_size", F.col("output_size"))  # noqa: E731 - in place of an encoder
    runs = []
    for run, rows in (("first", keyed.where("image_id % 3 = 0")), ("second", keyed)):
        found, counts = results.measure_once(rows, store, "shared_size long", measure, tasks=tasks)
        totals = found.agg(F.count("shared_size").alias("candidates"), F.sum("shared_size").alias("bytes"))
        runs.append(totals.select(F.lit(run).alias("run"), F.lit(counts["known"]).cast("long").alias("known"),
                                  F.lit(counts["measured"]).cast("long").alias("measured"), "candidates", "bytes"))
    both = cut_lineage(runs[0].unionByName(runs[1]))  # two rows, before the candidates are let go
    keyed.unpersist()
    return both


@query
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.measurements(spark, sf_dir)
    return candidates.first_occurrences(m, ["image_id"], "candidate_id").select(
        "image_id", "format", "quality", "lossless", "candidate_id", "n_occurrences"
    )


# Profiles, strategies and candidates ----------------------------------------------------------------------


@query
def classify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.profiles(spark, sf_dir)
    return p.select(
        "image_id", "category", "pixel_count",
        F.round(P.bytes_per_pixel(F.col("file_size"), F.col("pixel_count")), 6).alias("bytes_per_pixel"),
        P.is_very_large(F.col("file_size")).alias("very_large"),
        P.photo_like(F.col("category")).alias("photo_like"),
        F.round(P.aspect_ratio(F.col("width"), F.col("height")), 6).alias("aspect_ratio"),
        P.summary_line(F.col("format"), F.col("width"), F.col("height"), F.col("category"), F.col("complexity")).alias("summary"),
    )


@query
def tag_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.profiles(spark, sf_dir).select("image_id", F.explode("characteristics").alias("tag"))


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _under_every_goal(D.requests(spark, sf_dir))


def _under_every_goal(requests: DataFrame) -> DataFrame:
    """Strategies of requests. A table of images is small beside the work of its candidates, so it is spread first: one task may read it."""
    goals = F.array(*[F.lit(g[0]) for g in dims.GOALS])
    return strategy.assign_search_space(spread(requests, "image_id").withColumn("goal", F.explode(goals)))


@query
def assign_search_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image under every goal."""
    s = _strategies(spark, sf_dir)
    levels = F.transform(
        F.array_sort(F.filter(F.arrays_zip("candidate_formats", "quality_ranges"), lambda e: e["quality_ranges"].isNotNull())),
        lambda e: F.format_string(
            "%s:%d-%d/%d", e["candidate_formats"], e["quality_ranges"]["low"], e["quality_ranges"]["high"],
            e["quality_ranges"]["step"],
        ),
    )
    return s.select(
        "image_id", "goal", F.concat_ws(",", "candidate_formats").alias("formats"), F.concat_ws(",", levels).alias("ranges"),
        "include_lossy", "photo_sensitive", "metadata_mode", "keep_color_profile", "time_budget_ms", "blocked_reason",
        F.col("resize.width").alias("resize_width"), F.col("resize.height").alias("resize_height"), "rationale",
    )


@query
def generate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates.generate_candidates(_strategies(spark, sf_dir))
    return c.select(
        "image_id", "goal", "position", "kind", F.col("target").alias("format"), "quality", "lossless", "label", "reason",
        "applies", _r("effort"), "estimated_cost_ms",
    )


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every image of the library under every goal, planned from its own pixels."""
    pixels = written(D.library_pixels(spark, sf_dir))  # read by every measure and search
    profiles = profile_plan.build_profiles(D.library_files(spark, sf_dir), pixels)
    # Profiles feed the plan and the search: they are measured once.
    requests = cut_lineage(D.with_constraints(profiles))
    return _under_every_goal(requests), pixels


@query
def library_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files and pixels to one decision per image and goal, searches included."""
    d = library.optimize_library(*_library(spark, sf_dir))
    return d.select(
        "image_id", "goal", "outcome", "kept_original", "preference_fired", "original_size", "final_size", "selected.candidate_id",
        "selected.format", "selected.quality", "selected.lossless", "n_candidates", "n_measured", "n_survivors",
    )


@query
def library_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the candidates that were not kept, from rules to scores."""
    r = library.library_rejections(*_library(spark, sf_dir))
    return r.groupBy("goal", "stage", "reason", "format").agg(F.count(F.lit(1)).alias("n"))


@query
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.library_totals(library.optimize_library(*_library(spark, sf_dir)))


@query
def library_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality that each search of the library ends with, and how many rungs it measured."""
    strategies, pixels = _library(spark, sf_dir)
    planned = library.plan_library(strategies).where("stage IS NULL AND iterative")
    found = library.search_qualities(planned, cut_lineage(compare.pixel_tiles(pixels)), cut_lineage(rates.block_coefficients(pixels)))
    return found.select("image_id", "goal", F.col("target").alias("format"), F.col("q").cast("int").alias("quality"), "size", _r("damage"), "n_tried", "converged")


@query
def pixels_over_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as seen on a white page."""
    shown = [pixel_ops.over_white(c).alias(c) for c in ("r", "g", "b")]
    return D.pixels(spark, sf_dir).select("image_id", "x", "y", *shown)


@query
def scanline_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each image under every line filter."""
    return rates.scanline_sweep(D.pixels(spark, sf_dir)).select("image_id", "filter", _r("bits", 4))


@query
def lossless_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest lossless form of each image in either format, and the filter that gives it."""
    return rates.lossless_bits(D.library_pixels(spark, sf_dir)).select("image_id", "format", _r("bits", 4), "filter")


@query
def lossy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each image in each lossy format at the qualities of the long ladder."""
    pixels = D.library_pixels(spark, sf_dir)
    formats = F.explode(F.array(*[F.lit(f) for f in rates.LOSSY_FORMATS])).alias("format")
    steps = F.explode(F.array(*[sweep.step_of_quality(q) for q in dims.LADDER])).alias("step")
    wanted = D.library_files(spark, sf_dir).select("image_id", formats).select("image_id", "format", steps)
    return rates.lossy_bits(rates.block_coefficients(pixels), wanted).select("image_id", "format", "step", _r("bits", 4))


@query
def perceptual_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage at several scales of every rung of every image."""
    pairs = sweep.quantized_pairs(D.pixels(spark, sf_dir), dims.LADDER)
    return quality.perceptual_damage(pairs, ["image_id", "q"]).select("image_id", "q", _r("damage"))


@query
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each rule removes, by goal; files that are trivially small are not planned at all."""
    planned, _ = candidates.split_trivial(_strategies(spark, sf_dir))
    c = candidates.generate_candidates(planned)
    return c.groupBy("goal", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def trivial_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.split_trivial(D.profiles(spark, sf_dir))[1]


@query
def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("image_id")
    p = D.profiles(spark, sf_dir)
    size = strategy.target_size(
        F.col("width"), F.col("height"),
        F.when(k % 4 == 0, 640).cast("long"), F.when(k % 6 == 0, 480).cast("long"),
        F.when(k % 5 == 0, 12.5 * (k % 9)), F.when(k % 3 == 0, 800).cast("long"), F.when(k % 7 == 0, 600).cast("long"),
        F.when(k % 2 == 0, "Fit").when(k % 3 == 0, "Fill").otherwise("Stretch"),
    )
    return p.withColumn("s", size).select(
        "image_id", "width", "height", F.col("s.width").alias("target_width"), F.col("s.height").alias("target_height")
    )


@query
def adaptive_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = F.array(*[F.struct(F.lit(g[0]).alias("goal"), F.lit(g[10]).alias("base")) for g in dims.GOALS])
    rows = D.profiles(spark, sf_dir).withColumn("g", F.explode(goals))
    target = P.adaptive_target(
        F.col("g.base"), F.col("noise_estimate"), F.col("complexity"), F.col("dark_region_ratio"), F.col("edge_density")
    )
    return rows.select("image_id", "g.goal", F.round(target, 6).alias("target"))


@query
def format_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.format_usage(D.profiles(spark, sf_dir), dims.formats_table(spark))


# Pixels ---------------------------------------------------------------------------------------------------


def _stats(pixels: DataFrame) -> DataFrame:
    return pixel_ops.pixel_stats(pixels).select(
        "image_id", "n_pixels", _r("mean_luma"), _r("contrast"), _r("mean_saturation"), _r("dark_region_ratio"),
        _r("bright_region_ratio"),
    )


@query
def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(D.pixels(spark, sf_dir))


@query
def strip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over one pixel per line item."""
    return _stats(D.strips(spark, sf_dir))


@query
def luma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_ops.luma_histogram(D.strips(spark, sf_dir))


@query
def luma_histogram_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = pixel_ops.histogram_arrays(pixel_ops.luma_histogram(D.pixels(spark, sf_dir)))
    return arrays.select("image_id", F.concat_ws(",", F.col("luma_bins").cast("array<string>")).alias("luma_bins"))


@query
def color_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pixel_ops.pixel_stats(D.pixels(spark, sf_dir))
    files = D.image_files(spark, sf_dir).select("image_id", "format")
    model = P.color_model(F.col("format"), F.col("is_gray"), F.col("has_alpha"))
    return files.join(stats, "image_id").select("image_id", model.alias("color_model"), "has_alpha", "soft_alpha")


@query
def neighbour_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_ops.neighbour_stats(D.pixels(spark, sf_dir)).select(
        "image_id", "n_pairs", _r("complexity"), _r("compressibility"), _r("edge_density")
    )


@query
def flat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_ops.neighbour_stats(D.pixels(spark, sf_dir)).select("image_id", "flat_run_count")


@query
def preview_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour previews of at most 6 pixels a side."""
    sizes = D.image_files(spark, sf_dir).select("image_id", "width", "height")
    return pixel_ops.preview(D.pixels(spark, sf_dir), sizes, 6).select("image_id", "x", "y", "r", "g", "b")


@query
def build_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = D.pixels(spark, sf_dir)
    tasks = tasks_for(spark, 4 * pixels.count())  # a task sorts its pixels for each measure
    p = profile_plan.build_profiles(D.image_files(spark, sf_dir), pixels, tasks)
    return p.select(
        "image_id", "format", "category", F.concat_ws(",", "characteristics").alias("tags"), "color_model", _r("mean_luma"),
        _r("contrast"), _r("complexity"), _r("edge_density"), "flat_run_count", _r("flat_region_ratio"), _r("noise_estimate"),
        _r("lossy_probe_ssim"), _r("lossy_probe_bpp"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_copy(D.pixels(spark, sf_dir))


def _with_copy(original: DataFrame) -> DataFrame:
    """Originals joined with a distorted copy, quantized to steps of 16."""
    copy = original.select("image_id", "x", "y", *[sweep.quantized(c, F.lit(16)).alias(c) for c in ("r", "g", "b")], "a")
    return quality.pair_pixels(original, copy)


@query
def mse_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.mse_psnr(_pairs(spark, sf_dir))
    finite = F.when(F.col("mse") > 0, F.round("psnr", 6))
    return m.select("image_id", _r("mse"), finite.alias("psnr"), (F.col("mse") == 0).alias("is_lossless"))


@query
def ssim_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ssim_block(_pairs(spark, sf_dir)).select("image_id", _r("ssim"), "n_blocks")


@query
def ssim_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ssim_gauss(_pairs(spark, sf_dir)).select("image_id", _r("ssim"), "n_windows")


@query
def ssim_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels have no whole window; the general form falls back to the global similarity."""
    return quality.ssim(_with_copy(D.small_pixels(spark, sf_dir))).select("image_id", _r("ssim"))


@query
def evaluate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs per image, one declared lossless and one quantized, evaluated against the original."""
    original = D.pixels(spark, sf_dir)
    outputs = original.withColumn("candidate_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    outputs = outputs.select("image_id", "candidate_id", "x", "y", *[sweep.quantized(c, F.lit(32)).alias(c) for c in ("r", "g", "b")], "a")
    listed = D.image_files(spark, sf_dir).select("image_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("candidate_id"))
    listed = listed.withColumn("lossless", F.col("candidate_id") == "a")
    e = quality.evaluate(listed, original, outputs)
    finite = F.when(F.col("mse") > 0, F.round("psnr", 6))
    return e.select("image_id", "candidate_id", _r("mse"), finite.alias("psnr"), _r("ssim"), "is_lossless")


@query
def quantize_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sweep.quantize_sweep(D.pixels(spark, sf_dir))
    finite = F.when(F.col("mse") > 0, F.round("psnr", 6))
    return s.select("image_id", "q", _r("mse"), finite.alias("psnr"), _r("ssim"))


@query
def rung_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.rung_entropy(D.pixels(spark, sf_dir)).select("image_id", "q", _r("bits", 4), "n_pixels")


@query
def lossy_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.lossy_probe(D.pixels(spark, sf_dir)).select("image_id", _r("lossy_probe_ssim"), _r("lossy_probe_bpp"))


@query
def ladder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = D.format_rungs(spark, sf_dir)
    return ladder.ladder_scan(rungs, F.col("target"), ladder.ladder_of_format(F.col("format")), ("image_id", "format"))


@query
def ladder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = D.format_rungs(spark, sf_dir)
    found = ladder.ladder_search(rungs, F.col("target"), ladder.ladder_of_format(F.col("format")), ("image_id", "format"))
    return found.select("image_id", "format", "q", "size", _r("damage"), _r("target"), "n_tried", "converged")


@query
def png_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions read back from the header of every image; broken and foreign heads have none."""
    head = paths.png_header(F.col("content"))
    return D.header_blobs(spark, sf_dir).select("image_id", head.alias("h")).select(
        "image_id", "h.width", "h.height", "h.raw_size"
    )


@query
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of images of every format from their first bytes."""
    heads = D.image_heads(spark, sf_dir).select("image_id", paths.sniff_format(F.col("content")).alias("format"), "content")
    sized = heads.select("image_id", "format", headers.image_size(F.col("content"), F.col("format")).alias("s"))
    return sized.select("image_id", "format", "s.width", "s.height")


# Jobs and history -----------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_status(D.job_events(spark, sf_dir))


@query
def latest_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", "event_id", "status", "original_size", "final_size", "processing_time_ms")


@query
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_stats(_jobs(spark, sf_dir))


@query
def live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = jobs.live_stats(jobs.queue_stats(_jobs(spark, sf_dir)))
    rounded = {"compression_percentage", "files_per_second"}
    return live.select(*[_r(c) if c in rounded else F.col(c) for c in live.columns])


@query
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.batch_summary(jobs.live_stats(jobs.queue_stats(_jobs(spark, sf_dir))))


@query
def job_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_alerts(D.job_events(spark, sf_dir)).select("job_id", "event_id")


@query
def job_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_outcome(D.job_events(spark, sf_dir))


@query
def retry_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.when(F.col("job_id") % 4 != 0, F.col("job_id") % 3 + 1).cast("int")
    return jobs.retry_jobs(_jobs(spark, sf_dir).withColumn("attempt", tried)).select(
        "job_id", "attempt", "status", "original_size", "final_size", "processing_time_ms"
    )


@query
def clear_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.clear_jobs(_jobs(spark, sf_dir)).select("job_id", "status")


@query
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent_jobs(_jobs(spark, sf_dir)).select("job_id", "status", "final_size")


@query
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(D.measurements(spark, sf_dir))
    r = jobs.job_results(_jobs(spark, sf_dir), decided)
    return r.select("job_id", "status", "original_size", "final_size", "selected_format", "selected_quality", _r("percentage_saved"))


@query
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(D.history(spark, sf_dir)).select("id", "profile_name", "files_failed", "original_size", "output_size")


@query
def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history_totals(D.history(spark, sf_dir))


@query
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_lines(reports.recent_logs(D.logs(spark, sf_dir)))


# Requests, paths, content ---------------------------------------------------------------------------------


@query
def goal_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = goal_text.add_goal(D.goal_requests(spark, sf_dir), "prompt").withColumn(
        "force_format", goal_text.forced_format(F.col("force_format_text"))
    )
    weights = dims.goals_table(spark).select("goal", "max_candidates", F.concat_ws(",", "preferred_formats").alias("preferred"))
    return r.join(weights, "goal").select("request_id", "goal", "force_format", "max_candidates", "preferred")


@query
def goals_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document and conversation turn read as a goal request, by where it comes from and how often it asks for quality or size."""
    documents = D.read(spark, sf_dir, "documents").select("source", "text")
    turns = D.read(spark, sf_dir, "conversations").select(F.concat(F.lit("turn of "), "role").alias("source"), "text")
    read = goal_text.add_goal(documents.unionByName(turns), "text", identifiers=False)
    plain = goal_text.plain_text(F.col("text"))
    signals = goal_text.count_signals(plain, goal_text.LIGHT_SIGNALS) + goal_text.count_signals(plain, goal_text.QUALITY_SIGNALS)
    return read.groupBy("source", "goal", F.coalesce(signals, F.lit(0)).alias("signals")).agg(F.count(F.lit(1)).alias("n"))


@query
def validate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = paths.validation_issue(F.col("path"), F.col("length"), 4000)
    return D.paths(spark, sf_dir).select("file_id", issue.alias("issue"))


@query
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.output_path(
        F.col("path"), F.col("output_mode"), F.col("custom_folder"), F.col("preserve_structure"), F.col("template"),
        F.col("target_extension"),
    )
    picked = F.when(F.col("file_id") % 3 == 0, "WEBP").when(F.col("file_id") % 3 == 1, "JPEG")
    return D.paths(spark, sf_dir).withColumn("destination", out).select(
        "file_id", "destination", text.basename(F.col("destination")).alias("name"),
        paths.with_format_extension(F.col("destination"), picked).alias("final_path"),
    )


@query
def enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = ["Lossless", "quality", "Compress", "ExtremeLightweight", "other"]
    mode = F.get(F.array(*[F.lit(m) for m in modes]), (F.col("file_id") % 5).cast("int"))
    return jobs.enqueue(D.paths(spark, sf_dir), mode)


@query
def sniff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.file_blobs(spark, sf_dir).select("file_id", paths.sniff_format(F.col("content")).alias("real_format"))


@query
def extension_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = files.extension_audit(D.file_blobs(spark, sf_dir))
    return audit.select("file_id", "ext_format", "real_format", "matches", "renamed_path")


@query
def metadata_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metadata_audit(D.tags(spark, sf_dir), D.tagged_files(spark, sf_dir))


@query
def metadata_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metadata_fleet(reports.metadata_audit(D.tags(spark, sf_dir), D.tagged_files(spark, sf_dir)))


# Streams: the same tables read as a stream, run until all available rows are processed ---------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The pattern lets the table be one file or a folder of part files."""
    schema = D.read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.as_job_events(_stream(spark, sf_dir, "events"))


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    streams.stream_latest_status(_event_stream(spark, sf_dir), f"{base}/state", f"{base}/log").awaitTermination()
    rows = streams.current_state(spark, f"{base}/state")
    return rows.select("job_id", "event_id", "status", "original_size", "final_size", "processing_time_ms")


@query
def stream_queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    streams.stream_queue_stats(
        _event_stream(spark, sf_dir), f"{base}/state", f"{base}/stats", f"{base}/log"
    ).awaitTermination()
    return streams.newest_epoch(spark, f"{base}/stats")


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    streams.stream_alerts(_event_stream(spark, sf_dir), f"{base}/state", f"{base}/alerts", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/alerts").select("job_id", "event_id")


@query
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    streams.stream_outcomes(_event_stream(spark, sf_dir), f"{base}/state", f"{base}/log").awaitTermination()
    return streams.current_state(spark, f"{base}/state").select("job_id", "status")


@query
def stream_recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scratch(spark)
    logs = D.as_logs(_stream(spark, sf_dir, "events"))
    streams.stream_recent_logs(logs, f"{base}/kept", f"{base}/log").awaitTermination()
    return streams.newest_epoch(spark, f"{base}/kept").select("log_id", "level", "message")


@query
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive, listed by the pages table, as queued jobs."""
    base = _scratch(spark)
    arrived = D.as_paths(_stream(spark, sf_dir, "pages")).select("path", "length")
    streams.stream_arrivals(arrived, f"{base}/jobs", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/jobs").select("source", "destination", "input_format", "status", "goal")


# Sources and sinks: derived rows are written to the shared folder and read back ------------------------------


@query
def history_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended in two parts, with broken lines between, some removed, the newest kept."""
    base, runs = _scratch(spark), D.history(spark, sf_dir)
    for odd in (0, 1):
        records.append_history(runs.where(F.col("id") % 2 == odd), f"{base}/runs")
    broken = runs.select(F.concat(F.lit('{"id": '), F.col("id").cast("string")).alias("line"))
    broken.write.mode("append").text(f"{base}/runs")
    records.remove_history(spark, f"{base}/runs", f"{base}/fewer", runs.where("id % 5 = 0"))
    records.compact_history(spark, f"{base}/fewer", f"{base}/kept", 500)
    kept = records.read_history(spark, f"{base}/kept")
    return kept.select("id", "profile_name", "files_failed", "original_size", "output_size", "duration_ms")


@query
def catalogues_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile catalogues of suppliers, one JSON document per file, read leniently with their defaults."""
    base, k = _scratch(spark), F.col("s_suppkey")
    kinds = F.array(F.lit("Web"), F.lit("Lossless"), F.lit("Custom"), F.lit("Other"))

    def profile(i: int):
        return F.struct(
            F.concat(F.lit(f"p{i}-"), k.cast("string")).alias("name"), F.get(kinds, ((k + i) % 4).cast("int")).alias("kind"),
            (50 + (k * 7 + i) % 50).cast("int").alias("jpeg_quality"),
        )

    document = F.to_json(F.struct(
        F.array(*[profile(i) for i in range(3)]).alias("profiles"),
        F.when(k % 3 == 0, F.concat(F.lit("p1-"), k.cast("string"))).when(k % 3 == 1, "nobody").alias("default_name"),
    ))
    document = F.when(k % 7 == 0, F.lit("no json")).otherwise(document)
    files = D.read(spark, sf_dir, "supplier").select(k.alias("supplier"), document.alias("value"))
    # One file per supplier, written by all cores: partitionBy would make a folder for each, by the one task that reads the table.
    records.write_documents(files, "supplier", "value", f"{base}/catalogues")
    read = records.catalog_profiles(records.read_catalogs(spark, f"{base}/catalogues"))
    return read.select("name", "kind", "jpeg_quality", "is_default")


@query
def decisions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions published once and read back."""
    base = _scratch(spark)
    records.write_decisions(decisions.decide(D.measurements(spark, sf_dir)), f"{base}/decisions")
    return spark.read.parquet(f"{base}/decisions").select("image_id", "goal", "outcome", "final_size", "selected.candidate_id")


@query
def logs_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows exported as text and read back, with their number of characters."""
    base = _scratch(spark)
    records.export_logs(D.logs(spark, sf_dir), f"{base}/lines")
    return spark.read.text(f"{base}/lines").select(F.col("value").alias("line"), F.length("value").alias("n_chars"))


@query
def jobs_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs in order of their ids."""
    listed = jobs.list_jobs(_jobs(spark, sf_dir))
    return listed.select("job_id", "status", "original_size", "final_size")


@query
def preset_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each preset would ask of the images of each format: its quality and how many images."""
    presets = dims.presets_table(spark).select(
        "name", "metadata_mode", F.explode(F.map_from_arrays(
            F.array(F.lit("JPEG"), F.lit("WEBP"), F.lit("AVIF")), F.array("jpeg_quality", "webp_quality", "avif_quality")
        )).alias("format", "quality"))
    images = D.profiles(spark, sf_dir).groupBy("format").agg(F.count(F.lit(1)).alias("images"), F.sum("pixel_count").alias("pixels"))
    return images.join(presets, "format").select("format", "name", "metadata_mode", "quality", "images", "pixels")
