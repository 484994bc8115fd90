"""Job state from events, queue statistics, alerts, and the queue's operations as table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.functions import goals as G
from sizewise.functions import paths as X
from sizewise.functions.scoring import percentage_saved
from sizewise.functions.text import format_bytes, format_duration, format_percent
from sizewise.operators.skew import previous_by_bucket

# Job states.
STATUSES = ["Queued", "Processing", "Completed", "Failed", "Cancelled", "Skipped"]
FINISHED = ["Completed", "Failed", "Cancelled", "Skipped"]
RETRYABLE = ["Failed", "Cancelled"]
REARMING = ["Completed", "Cancelled"]
RECENT_JOBS = 8
#: Stretch of time in which the events of a job are looked at together.
ALERT_BUCKET_SECONDS = 3600


def latest_status(events: DataFrame) -> DataFrame:
    """Current row of each job: the last event by time, then by event id. Works on a stream as well."""
    payload = F.struct(*[c for c in events.columns if c != "job_id"])
    latest = F.max_by(payload, F.struct("ts", "event_id")).alias("_latest")
    return events.groupBy("job_id").agg(latest).select("job_id", "_latest.*")


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Counts by state and totals of completed jobs in one row."""
    done = F.col("status") == "Completed"
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(column))), F.lit(0)).alias(name)

    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *counts,
        total("original_size", "original_bytes"),
        total("final_size", "final_bytes"),
        total("processing_time_ms", "total_processing_ms"),
    )


def live_stats(stats: DataFrame) -> DataFrame:
    """Savings and speed of the queue; ratios are 0 while nothing has been processed."""
    seconds = F.col("total_processing_ms") / 1000.0
    speed = F.coalesce(F.try_divide(F.col("completed"), seconds), F.lit(0.0))
    return stats.select(
        F.col("completed").alias("files_processed"),
        F.col("failed").alias("files_failed"),
        F.col("queued").alias("files_queued"),
        F.col("processing").alias("files_processing"),
        F.col("original_bytes").alias("bytes_in"),
        F.col("final_bytes").alias("bytes_out"),
        "total_processing_ms",
        (F.col("original_bytes") - F.col("final_bytes")).alias("space_saved_bytes"),
        percentage_saved(F.col("original_bytes"), F.col("final_bytes")).alias("compression_percentage"),
        speed.alias("files_per_second"),
    )


def batch_summary(live: DataFrame) -> DataFrame:
    """The live statistics as one line of text."""
    saved = F.col("space_saved_bytes")
    text = F.concat_ws(
        ", ",
        F.format_string("%d files", F.col("files_processed")),
        F.concat(format_bytes(F.col("bytes_in")), F.lit(" -> "), format_bytes(F.col("bytes_out"))),
        F.concat(
            F.when(saved < 0, "grew by ").otherwise("saved "), format_bytes(F.abs(saved)), F.lit(" ("),
            format_percent(F.col("compression_percentage")), F.lit(")"),
        ),
        format_duration(F.col("total_processing_ms")),
    )
    return live.select(text.alias("summary"))


def job_alerts(events: DataFrame, bucket_seconds: int = ALERT_BUCKET_SECONDS) -> DataFrame:
    """One alert per failure; a further failure alerts only after the job completed or was cancelled.

    Among the events that matter, a failure is announced exactly when the event before it is not a failure. The event before is
    looked for by stretches of ``bucket_seconds``, so that a job with very many events is no single task.
    """
    relevant = events.where(F.col("status").isin("Failed", *REARMING)).select("job_id", "event_id", "ts", "status")
    relevant = relevant.withColumn("_ts", F.unix_micros(F.col("ts").cast("timestamp")))
    bucket = F.floor(F.col("_ts") / (bucket_seconds * 1_000_000))
    seen = previous_by_bucket(relevant, ["job_id"], ["_ts", "event_id"], "status", "_before", bucket)
    return seen.where(is_alert(F.col("_before"))).select("job_id", "event_id", "ts")


def is_alert(before: Column) -> Column:
    """A failure that does not follow a failure."""
    return (F.col("status") == "Failed") & (F.coalesce(before, F.lit("none")) != "Failed")


def job_outcome(events: DataFrame) -> DataFrame:
    """Final state of each job under the rule that a cancel wins over a later result.

    A cancel only acts on a job that is queued or processing, that is, before its first result. A new Queued event
    starts the job over, so only the events since the last one count. Both steps are aggregates that combine before
    the shuffle, and the join between them has one row per job on one side, so adaptive execution can split a hot job.
    """
    return settled(events, F.struct("ts", "event_id"))


def settled(events: DataFrame, at: Column) -> DataFrame:
    """The same for events in the order of ``at``."""
    terminal = F.col("status").isin("Completed", "Failed", "Cancelled")
    started = events.groupBy("job_id").agg(F.max(F.when(F.col("status") == "Queued", at)).alias("_start"))
    current = events.join(started, "job_id").where(F.col("_start").isNull() | (at >= F.col("_start")))
    return current.groupBy("job_id").agg(
        F.min_by("status", F.when(terminal, at)).alias("_final"), F.max_by("status", at).alias("_last")
    ).select("job_id", F.coalesce("_final", "_last").alias("status"))


def retry_jobs(jobs: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Queue after a retry: failed and cancelled jobs are replaced by fresh queued ones with results zeroed.

    ``new_id`` gives the id of the new job; by default the old id is kept. A fresh job counts one attempt more than the
    one it replaces, a table without ``attempt`` being at its first; the attempts of the other jobs stay as they are.
    """
    again = F.coalesce(F.col("status").isin(RETRYABLE), F.lit(False))
    tried = F.coalesce("attempt", F.lit(1)) if "attempt" in jobs.columns else F.lit(1)
    jobs = jobs.withColumn("attempt", tried.cast("int"))
    fresh = jobs.where(again)
    results = {c: F.lit(0).cast("long") for c in ("original_size", "final_size", "processing_time_ms") if c in jobs.columns}
    fresh = fresh.withColumns({**results, "status": F.lit("Queued"), "attempt": F.col("attempt") + 1})
    if new_id is not None:
        fresh = fresh.withColumn("job_id", new_id)
    return jobs.where(~again).unionByName(fresh)


def clear_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(FINISHED))


def list_jobs(jobs: DataFrame) -> DataFrame:
    """All jobs in order of their ids: a range-partitioned sort, so nothing is gathered."""
    return jobs.orderBy("job_id")


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    return jobs.orderBy(F.desc("job_id")).limit(n)


def job_results(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Jobs filled with the decision on their image: sizes, format and quality label."""
    label = (
        F.when(F.col("selected").isNull(), None)
        .when(F.col("selected.lossless"), "lossless")
        .when(F.col("selected.quality").isNull(), "auto")
        .otherwise(F.format_string("q%d", F.col("selected.quality")))
    )
    joined = jobs.drop("original_size", "final_size").join(
        decisions, F.col("job_id") == F.col("image_id")
    )
    return joined.select(
        "job_id", "status", "original_size", "final_size", F.col("selected.format").alias("selected_format"),
        label.alias("selected_quality"),
        percentage_saved(F.col("original_size"), F.col("final_size")).alias("percentage_saved"),
    )


def enqueue(files: DataFrame, mode: Column | None = None, max_bytes: int = 0) -> DataFrame:
    """One row per file (path, length, and the output columns of ``paths.output_path``).

    A file that can be worked on becomes a queued job. Any other row says in ``issue`` what is wrong with its path, or that
    the output would overwrite it, and has no status.
    """
    destination = X.output_path(
        F.col("path"), F.col("output_mode"), F.col("custom_folder"), F.col("preserve_structure"), F.col("template"),
        F.col("target_extension"),
    )
    goal = G.goal_of_mode(F.lit("Quality") if mode is None else mode)
    issue = X.validation_issue(F.col("path"), F.col("length"), max_bytes)
    rows = files.withColumn("_issue", issue).withColumn("_destination", destination)
    issue = F.when(F.col("_issue") != "Ok", F.col("_issue")).when(F.col("_destination") == F.col("path"), "SameFile")
    rows = rows.withColumn("_issue", issue)

    def queued(value: Column) -> Column:
        return F.when(F.col("_issue").isNull(), value)

    return rows.select(
        "file_id",
        F.col("path").alias("source"),
        queued(F.col("_destination")).alias("destination"),
        queued(X.format_of_extension(X.extension(F.col("path")))).alias("input_format"),
        queued(F.lit("Queued")).alias("status"),
        queued(goal).alias("goal"),
        F.col("_issue").alias("issue"),
    )
