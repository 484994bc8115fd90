"""Reports over decisions, rejections, encodes, history and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.functions.scoring import percentage_saved
from sizewise.functions.text import format_bytes

HISTORY_KEEP = 1000
LOGS_KEEP = 5000


def batch_totals(decisions: DataFrame) -> DataFrame:
    """Totals of a batch. Failures are told apart from kept originals before anything else is counted."""
    failed = F.col("outcome") == "all_failed"
    picked = F.col("outcome") == "selected"
    return decisions.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(picked).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.count_if(~failed & ~picked).alias("kept_original"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_original_bytes"),
        F.coalesce(F.sum("final_size"), F.lit(0)).alias("total_final_bytes"),
    )


def batch_elapsed(measurements: DataFrame, elapsed: Column) -> DataFrame:
    return measurements.agg(F.coalesce(F.sum(elapsed), F.lit(0)).alias("total_processing_ms"))


def outcome_partition(decisions: DataFrame) -> DataFrame:
    """How the images split by goal and outcome; every image falls into exactly one outcome."""
    return decisions.groupBy("goal", "outcome").agg(
        F.count(F.lit(1)).alias("images"), F.sum("original_size").alias("original_bytes"),
        F.sum("final_size").alias("final_bytes"),
    )


def rejection_rollup(rejections: DataFrame) -> DataFrame:
    """Rejections by goal, format and reason with subtotals; ``level`` counts the columns rolled up."""
    return (
        rejections.rollup("goal", "format", "reason")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_id"))
        .withColumn("level", F.bit_count("_id").cast("int"))
        .drop("_id")
    )


def rejection_counts(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def explanations(decisions: DataFrame) -> DataFrame:
    """One sentence per decision (with its runner-up), from its own numbers."""
    rows = decisions.withColumn("next_id", F.col("runner_up.candidate_id")).withColumn(
        "next_score", F.col("runner_up.score")
    )
    saved = percentage_saved(F.col("original_size"), F.col("final_size"))
    chosen = F.concat_ws(
        "; ",
        F.format_string(
            "%s %s wins under %s with score %.4f",
            F.col("selected.format"), F.col("selected.candidate_id"), F.col("goal"), F.round("selected.score", 4),
        ),
        F.format_string(
            "%d of %d bytes, %.1f%% saved", F.col("final_size"), F.col("original_size"), F.round(saved, 1)
        ),
        F.when(F.col("selected.is_lossless"), F.lit("lossless")).otherwise(
            F.format_string("SSIM %.4f", F.round("selected.ssim", 4))
        ),
        F.when(F.col("preference_fired"), F.lit("lossless preferred at no extra size")),
        F.when(
            F.col("next_id").isNotNull(), F.format_string("next best %s (%.4f)", F.col("next_id"), F.round("next_score", 4))
        ),
    )
    kept = F.concat(
        F.lit("original kept: "),
        F.when(F.col("outcome") == "all_failed", F.format_string("all %d candidates failed", F.col("n_candidates")))
        .when(F.col("outcome") == "all_rejected", F.lit("all candidates were rejected"))
        .otherwise(F.format_string("nothing smaller than %s", format_bytes(F.col("original_size")))),
    )
    return rows.select(
        "image_id", F.when(F.col("selected").isNotNull(), chosen).otherwise(kept).alias("explanation")
    )


def decision_history(decisions: DataFrame, mode: str, timestamp: Column, duration_ms: Column) -> DataFrame:
    """History rows from decisions. ``auto`` logs a kept original as a failed file; ``queue`` leaves it out."""
    if mode not in ("auto", "queue"):
        raise ValueError(f"unknown history mode {mode!r}")
    kept = F.col("kept_original").cast("int")
    rows = decisions if mode == "auto" else decisions.where(~F.col("kept_original"))
    return rows.select(
        F.col("image_id").alias("id"),
        timestamp.alias("timestamp"),
        F.concat(F.lit(f"{mode}:"), F.col("goal")).alias("profile_name"),
        (1 - kept).alias("files_processed"),
        kept.alias("files_failed"),
        "original_size",
        F.col("final_size").alias("output_size"),
        duration_ms.alias("duration_ms"),
    )


def history_totals(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("total_runs"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{n}")
            for c, n in (
                ("files_processed", "files_processed"), ("files_failed", "files_failed"),
                ("original_size", "original_bytes"), ("output_size", "output_bytes"), ("duration_ms", "duration_ms"),
            )
        ],
    )


def newest(history: DataFrame, n: int = HISTORY_KEEP) -> DataFrame:
    """Newest runs first, ties by id; a top-k, not a full sort."""
    return history.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def recent_logs(logs: DataFrame, n: int = LOGS_KEEP) -> DataFrame:
    return logs.orderBy(F.desc("ts"), F.desc("log_id")).limit(n)


def log_lines(logs: DataFrame) -> DataFrame:
    """Log rows as text. A timestamp that cannot be read as a time is printed as it is."""
    at = F.date_format(F.try_to_timestamp("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = F.format_string(
        "%s [%s] [%s] %s", F.coalesce(at, F.col("timestamp")), F.col("level"), F.col("source"), F.col("message")
    )
    return logs.select("log_id", line.alias("line"))


# Every setting of an encoder that changes the bytes it writes.
ENCODE_SETTINGS = [
    "format", "quality", "lossless", "alpha_quality", "time_budget_ms", "metadata_mode", "preserve_color_profile", "resize_mode",
    "resize_width", "resize_height",
]


def encode_key(measurements: DataFrame) -> DataFrame:
    """Add the key under which two encodes of one image give the same bytes. NULL settings keep their place."""
    return measurements.withColumn(
        "encode_key", F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in ENCODE_SETTINGS])
    )


def encodes_to_run(keyed: DataFrame) -> DataFrame:
    """One row per distinct encode: its first candidate, and how many candidates share it."""
    return keyed.groupBy("image_id", "encode_key").agg(
        F.min("candidate_id").alias("candidate_id"), F.count(F.lit(1)).alias("n_candidates")
    )


def share_encodes(keyed: DataFrame, measured: DataFrame) -> DataFrame:
    """Give every candidate the result measured once for its key (image_id, encode_key, ...)."""
    return keyed.join(measured, ["image_id", "encode_key"], "left")


def reuse_ratio(runs: DataFrame) -> DataFrame:
    """Encodes avoided and encodes run. Every key is one miss; further candidates of it are hits."""
    misses, total = F.count(F.lit(1)), F.sum("n_candidates")
    return runs.agg((total - misses).alias("hits"), misses.alias("misses"), ((total - misses) / total).alias("hit_ratio"))


def metadata_audit(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata summary of every file (image_id, format), with or without tags (image_id, pos, tag, value).

    The last make, model, software, orientation and dimensions count, the first date of any kind, and whether there is a
    position. Dimensions that are no numbers are left out.
    """

    def of(*names: str) -> Column:
        return F.when(F.col("tag").isin(*names), F.col("pos"))

    def number(*names: str) -> Column:
        value = F.expr("try_cast(value AS INT)")
        return F.max_by(value, F.when(value.isNotNull(), of(*names)))

    read = tags.groupBy("image_id").agg(
        F.lit(True).alias("has_exif"),
        F.bool_or(F.col("tag") == "GPS").alias("has_gps"),
        F.max_by("value", of("Make")).alias("camera_make"),
        F.max_by("value", of("Model")).alias("camera_model"),
        F.max_by("value", of("Software")).alias("software"),
        F.min_by("value", of("DateTime", "DateTimeOriginal", "DateTimeDigitized")).alias("first_datetime"),
        F.max_by("value", of("Orientation")).alias("orientation"),
        number("PixelXDimension", "ImageWidth").alias("exif_width"),
        number("PixelYDimension", "ImageLength").alias("exif_height"),
    )
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_exif", "has_gps")}
    return files.select("image_id", "format").join(read, "image_id", "left").withColumns(flags)


def metadata_fleet(audit: DataFrame) -> DataFrame:
    return audit.groupBy("format").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if("has_exif").alias("with_exif"),
        F.count_if("has_gps").alias("with_gps"),
        F.count_if(F.col("camera_make").isNotNull()).alias("with_make"),
    )


def format_usage(profiles: DataFrame, formats: DataFrame) -> DataFrame:
    """The format catalogue with how many images and bytes each format holds."""
    used = profiles.groupBy("format").agg(F.count(F.lit(1)).alias("images"), F.sum("file_size").alias("bytes"))
    return formats.join(used, "format", "left").select(
        "format", "code", F.concat_ws(",", "extensions").alias("extensions"), "can_read", "can_write", "can_optimize",
        "can_convert", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )
