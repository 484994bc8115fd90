"""The whole chain for a library of images: strategies, candidates, measurements from pixels, decisions, all rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.dims import goals_table
from sizewise.functions.profile import adaptive_target
from sizewise.functions.scoring import needs_perceptual_metric
from sizewise.operators.compare import compare_steps, pixel_tiles
from sizewise.operators.ladder import ladder_of_format, search_frontier
from sizewise.operators.pixels import PIXEL_JOIN
from sizewise.operators.rates import block_coefficients, lossless_bits, lossy_bits
from sizewise.operators.sweep import pairs_of, step_of_quality
from sizewise.plans.candidates import generate_candidates
from sizewise.plans.decide import annotate, choose, rejections
from sizewise.session import cut_lineage

# Bytes that a file has besides its pixels.
HEADER_BYTES = 64
# A lossy candidate without a quality is measured at this one.
SOURCE_QUALITY = 90
# Rungs that a search asks for at a time: measuring one more is cheaper here than another round.
RUNGS_AHEAD = 4


def bytes_of(bits: Column) -> Column:
    return (HEADER_BYTES + F.ceil(bits / 8)).cast("long")


def distortions(pixels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs of pixels and their quantized copies for each distinct (image_id, step) of ``wanted``, the step also as ``q``."""
    return pairs_of(pixels.join(wanted.select("image_id", "step").distinct().hint(PIXEL_JOIN), "image_id").withColumn("q", F.col("step")))


def search_qualities(planned: DataFrame, tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """The quality that each searching candidate ends with: (image_id, goal, target, q, damage, n_tried, converged).

    Every image, goal and format is one search down the ladder of the format, for the damage that the goal allows for such an image.
    Qualities with one quantization step share a measurement. ``tiles`` and ``blocks`` are read in every round.
    """
    goals = goals_table(planned.sparkSession).select("goal", F.col("perceptual_target").alias("_base"))
    limit = adaptive_target(F.col("_base"), F.col("noise_estimate"), F.col("complexity"), F.col("dark_region_ratio"), F.col("edge_density"))
    searches = planned.where("iterative").join(goals, "goal").select(
        "image_id", "goal", F.col("target").alias("format"), limit.alias("target"), ladder_of_format(F.col("target")).alias("ladder"))

    def measure(asked: DataFrame) -> DataFrame:
        stepped = asked.withColumn("step", step_of_quality(F.col("q")))
        sizes = lossy_bits(blocks, stepped.select("image_id", "format", "step").distinct())
        damage = compare_steps(tiles, stepped).select("image_id", "step", "damage")
        rows = stepped.join(sizes, ["image_id", "format", "step"]).join(damage, ["image_id", "step"])
        return rows.select("image_id", "format", "q", bytes_of(F.col("bits")).alias("size"), "damage")

    found = search_frontier(searches, measure, ("image_id", "goal", "format"), ("image_id", "format"), RUNGS_AHEAD)
    return found.withColumnRenamed("format", "target")


def measure_candidates(candidates: DataFrame, pixels: DataFrame) -> DataFrame:
    """Measure planned candidates on the pixels of their images, as ``score.MEASUREMENT_COLUMNS``.

    Searching candidates first find their quality. A quality stands for a quantization step; the size follows the rate model of the
    format, for lossless candidates the best scanline filter. Candidates of one image with the same step share the comparison, those of
    one format also the size. The perceptual damage is told only where a gate asks for it, a search did, or the similarity leaves doubt.
    A candidate that no encoder applies to, or whose image has no pixels, becomes a failed row with the cause in ``error``.
    """
    keys = ["image_id", "goal", "candidate_id"]
    planned = candidates.withColumn(
        "candidate_id", F.concat_ws("-", F.format_string("%03d", "position"), F.translate("label", " ", "-")))
    # Coefficients and pixels are asked for in every round of the search: they are computed or packed once and survive a lost executor.
    blocks = cut_lineage(block_coefficients(pixels.join(planned.where("(applies OR iterative) AND NOT lossless").select("image_id").distinct(), "image_id", "left_semi")))
    tiles = cut_lineage(pixel_tiles(pixels.join(planned.where("applies OR iterative").select("image_id").distinct(), "image_id", "left_semi")))
    searched = search_qualities(planned, tiles, blocks).select("image_id", "goal", "target", F.col("q").alias("_q"), F.col("damage").alias("_found"))
    level = F.when(~F.col("lossless"), F.coalesce("quality", F.when(F.col("iterative"), F.col("_q")).otherwise(F.lit(SOURCE_QUALITY))))
    # A search needs no backend. One that found nothing is an ordinary candidate and fails as such.
    found = F.col("iterative") & F.col("_q").isNotNull()
    planned = planned.join(searched, ["image_id", "goal", "target"], "left").withColumn("q", level.cast("int"))
    planned = planned.withColumn("applies", F.col("applies") | found).withColumn("iterative", found)
    planned = planned.withColumn("_found", F.when(found, F.col("_found")))  # the other candidates of the format have their own damage
    planned = planned.withColumn("step", F.when(F.col("lossless"), 1).otherwise(step_of_quality(F.col("q"))))

    lossy = planned.where("applies AND NOT lossless").select("image_id", F.col("target").alias("format"), "step").distinct()
    sizes = lossy_bits(blocks, lossy).unionByName(
        lossless_bits(pixels).select("image_id", "format", F.lit(None).cast("int").alias("step"), "bits"))
    sizes = sizes.select("image_id", F.col("format").alias("target"), F.col("step").isNull().alias("lossless"), F.coalesce("step", F.lit(1)).alias("step"), "bits")
    compared = compare_steps(tiles, planned.where("applies").select("image_id", "step"))
    goals = goals_table(planned.sparkSession).select("goal", F.col("perceptual_gate").alias("_gate"))
    rows = planned.join(sizes, ["image_id", "target", "lossless", "step"], "left").join(compared, ["image_id", "step"], "left").join(goals, "goal", "left")
    is_lossless = F.col("lossless") | F.coalesce(F.col("mse") == 0, F.lit(False))
    doubt = F.col("applies") & needs_perceptual_metric(is_lossless, F.col("ssim"), F.col("_found"), F.coalesce("_gate", F.lit(False)))
    rows = rows.withColumn("_doubt", F.coalesce(doubt, F.lit(False)))

    error = (
        F.when(~F.col("applies"), "not_applicable").when(F.col("mse").isNull(), "no_pixels").when(F.col("bits").isNull(), "no_size")
    )
    rows = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select(
        *keys,
        F.col("file_size").alias("original_size"),
        F.when(ok, bytes_of(F.col("bits"))).alias("output_size"),
        F.col("target").alias("format"),
        "lossless",
        "iterative",
        F.col("q").alias("quality"),
        ok.alias("success"),
        F.when(ok, F.col("ssim")).alias("ssim"),
        F.when(ok & (F.col("mse") > 0), F.col("psnr")).alias("psnr"),
        F.when(ok, F.col("mse")).alias("mse"),
        F.when(ok, F.coalesce("_found", F.when(F.col("_doubt"), F.col("damage")))).alias("perceptual"),
        "estimated_cost_ms",
        "photo_like",
        "lossy_probe_ssim",
        "error",
    )


def plan_library(strategies: DataFrame) -> DataFrame:
    """Candidates of images under goals, with the stage at which one is given up and a ``candidate_id``."""
    reason = F.col("reason")
    stage = F.when(reason == "same_decade", "ex_ante").when(reason == "over_cap", "cap").when(reason.isNotNull(), "rule")
    return generate_candidates(strategies).withColumn("stage", stage)


def optimize_library(strategies: DataFrame, pixels: DataFrame) -> DataFrame:
    """One decision per image and goal that has a candidate worth measuring."""
    return choose(annotate(measure_candidates(plan_library(strategies).where("stage IS NULL"), pixels)))


def library_rejections(strategies: DataFrame, pixels: DataFrame) -> DataFrame:
    """Every candidate that was given up, whether by a rule, ahead of encoding, by the cap, in measurement or by score.

    A candidate that could not be measured has the cause as its reason.
    """
    planned = plan_library(strategies)
    early = planned.where("stage IS NOT NULL").select(
        "image_id", "goal", F.concat_ws("-", F.format_string("%03d", "position"), F.translate("label", " ", "-")).alias("candidate_id"),
        F.col("target").alias("format"), "stage", "reason",
    )
    late = rejections(annotate(measure_candidates(planned.where("stage IS NULL"), pixels)))
    return early.unionByName(late.select(*early.columns))


def library_totals(decisions: DataFrame) -> DataFrame:
    """Images, outcomes and bytes by goal."""
    return decisions.groupBy("goal").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("outcome") == "selected").alias("selected"),
        F.count_if(F.col("outcome") == "all_failed").alias("failed"),
        F.sum("original_size").alias("original_bytes"),
        F.sum("final_size").alias("final_bytes"),
    )
