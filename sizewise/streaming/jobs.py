"""Job events as streams: current state, statistics, alerts, the cancel rule, arrivals and the recent log.

Streams write to parquet folders and never through the driver. Every micro-batch owns one sub-folder that it
overwrites, so a batch that is replayed after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sizewise.operators.skew import previous_by_bucket
from sizewise.plans import jobs as J
from sizewise.plans.reports import LOGS_KEEP, recent_logs


#: Hash buckets of a table of state.
BUCKETS = 64
HEADS = "bucket int, at long, newest string"
#: The stretch of what is remembered, before all times.
FIRST = -(1 << 62)


def batch_folder(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


def _write_epochs(stream: DataFrame, folder: str, checkpoint: str, mode: str) -> StreamingQuery:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(folder, epoch))

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """The table as the last micro-batch left it. The folder of an epoch is a partition, so only one is read."""
    epochs = spark.read.parquet(folder)
    return epochs.where(F.col("epoch") == epochs.agg(F.max("epoch")).scalar()).drop("epoch")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def _heads(spark: SparkSession, state: str, epoch: int) -> dict[int, tuple[int, str | None]]:
    """The epoch that wrote each bucket of the state as epoch ``epoch`` left it, and the newest time seen; a row per bucket."""
    rows = spark.read.schema(HEADS).parquet(batch_folder(f"{state}/heads", epoch)).collect()
    return {r["bucket"]: (r["at"], r["newest"]) for r in rows}


def _rows_of(spark: SparkSession, state: str, heads: dict[int, tuple[int, str | None]], buckets: list[int]) -> DataFrame | None:
    paths = [f"{batch_folder(f'{state}/rows', heads[k][0])}/bucket={k}" for k in buckets if k in heads]
    return spark.read.option("basePath", f"{state}/rows").parquet(*paths).drop("epoch", "bucket") if paths else None


def _alive(rows: DataFrame, newest: str | None, expire_seconds: int | None) -> DataFrame:
    """Without finished jobs whose last event lies more than ``expire_seconds`` before the newest one."""
    if expire_seconds is None or newest is None:
        return rows
    over = F.col("status").isin(J.FINISHED) & (F.col("ts").cast("timestamp") < _limit(newest, expire_seconds))
    return rows.where(~over)


def _limit(newest: str, expire_seconds: int) -> Column:
    return F.lit(newest).cast("timestamp") - F.make_interval(secs=F.lit(expire_seconds))


def _fold(
    events: DataFrame, state: str, checkpoint: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame],
    also: Callable[[DataFrame | None, DataFrame, DataFrame, int], None] | None = None,
    expire_seconds: int | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep a table of state in hash buckets of the job: each micro-batch rewrites only the buckets of its own jobs.

    ``state`` has two folders: ``rows`` by epoch and bucket, and ``heads``, which names for each epoch the epoch that wrote each bucket.
    A batch reads the heads of the epoch before, the rows of the buckets it touches, and writes ``fold(their state, its events)`` and the
    new heads; a replay overwrites the same folders. ``also`` sees the old state of those buckets, the events, their new state and the epoch.
    Rows that no head of the last two epochs names are removed. With ``expire_seconds`` finished jobs leave the state so long after their
    last event by the clock of the events, and later events from before that time are ignored. A folder that an earlier run filled is
    refused when a stream starts anew.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0 and _exists(spark, batch_folder(f"{state}/heads", 1)):
            raise ValueError(f"{state} holds the state of another checkpoint")
        heads = _heads(spark, state, epoch - 1) if epoch > 0 else {}
        times = batch.agg(F.max(F.col("ts").cast("timestamp")).cast("string").alias("t"), F.collect_set(_bucket(buckets)).alias("b")).first()
        touched = sorted(times["b"])  # at most the number of buckets
        newest = max([t for t in [times["t"], *[n for _, n in heads.values()]] if t is not None], default=None)
        if expire_seconds is not None and newest is not None:
            batch = batch.where(F.col("ts").isNull() | (F.col("ts").cast("timestamp") >= _limit(newest, expire_seconds)))
        before = _rows_of(spark, state, heads, touched)
        new = _alive(fold(before, batch), newest, expire_seconds).withColumn("bucket", _bucket(buckets))
        folder = batch_folder(f"{state}/rows", epoch)
        new.repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # A bucket whose jobs have all left has no folder.
        left = {k for k in touched if _exists(spark, f"{folder}/bucket={k}")}
        now = {k: at for k, (at, _) in heads.items() if k not in touched} | {k: epoch for k in left}
        rows = [(k, at, newest) for k, at in sorted(now.items())]
        spark.createDataFrame(rows, HEADS).coalesce(1).write.mode("overwrite").parquet(batch_folder(f"{state}/heads", epoch))
        if also is not None:
            current = _rows_of(spark, state, {k: (epoch, newest) for k in left}, touched)
            also(before, batch, fold(None, batch.limit(0)) if current is None else current, epoch)
        if epoch > 1:
            older = _heads(spark, state, epoch - 2)
            for k, (at, _) in older.items():
                if heads.get(k, (None, None))[0] != at and now.get(k) != at:
                    _remove(spark, f"{batch_folder(f'{state}/rows', at)}/bucket={k}")

    return (
        events.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _path(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _exists(spark: SparkSession, path: str) -> bool:
    store, found = _path(spark, path)
    return store.exists(found)


def _remove(spark: SparkSession, path: str) -> None:
    store, found = _path(spark, path)
    store.delete(found, True)


def current_state(spark: SparkSession, state: str, expire_seconds: int | None = None) -> DataFrame:
    """The table of state as the last micro-batch left it."""
    epoch = spark.read.schema(f"{HEADS}, epoch long").parquet(f"{state}/heads").agg(F.max("epoch")).first()[0]
    heads = _heads(spark, state, epoch)
    rows = _rows_of(spark, state, heads, sorted(heads))
    if rows is None:  # every job has left
        return spark.read.parquet(f"{state}/rows").drop("epoch", "bucket").limit(0)
    return _alive(rows, max((n for _, n in heads.values() if n), default=None), expire_seconds)


def _after(before: DataFrame | None, events: DataFrame) -> DataFrame:
    """Events behind the remembered one of each job; ``arrival`` puts what was remembered first."""
    rows = events.withColumn("arrival", F.lit(1))
    return rows if before is None else before.withColumn("arrival", F.lit(0)).unionByName(rows)


def _latest(before: DataFrame | None, events: DataFrame) -> DataFrame:
    rows = events if before is None else before.unionByName(events.select(*before.columns))
    return J.latest_status(rows).select(*events.columns)


def stream_latest_status(events: DataFrame, folder: str, checkpoint: str, expire_seconds: int | None = None) -> StreamingQuery:
    """Keep the current row of each job, read with ``current_state``."""
    return _fold(events, folder, checkpoint, _latest, expire_seconds=expire_seconds)


def stream_queue_stats(events: DataFrame, state: str, stats: str, checkpoint: str) -> StreamingQuery:
    """After each batch, statistics over the current state of all jobs.

    All of them are counts and sums, so a batch takes from the last statistics what its own jobs were and adds what they are.
    """

    def report(before: DataFrame | None, batch: DataFrame, current: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parts = [(J.queue_stats(current), 1)]
        if before is not None:
            parts.append((J.queue_stats(before), -1))
        if epoch > 0:
            parts.append((spark.read.parquet(batch_folder(stats, epoch - 1)), 1))
        signed = [df.select([(F.col(c) * sign).alias(c) for c in df.columns]) for df, sign in parts]
        every = reduce(DataFrame.unionByName, signed)
        every.agg(*[F.sum(c).alias(c) for c in every.columns]).write.mode("overwrite").parquet(batch_folder(stats, epoch))

    return _fold(events, state, checkpoint, _latest, report)


def stream_alerts(events: DataFrame, state: str, folder: str, checkpoint: str,
                  bucket_seconds: int = J.ALERT_BUCKET_SECONDS) -> StreamingQuery:
    """One alert per failure, armed again when the job completes or is cancelled; each epoch of ``folder`` has its alerts.

    The state is the last event that matters of each job. With it in front, the rule of the batch form holds within the batch.
    """
    columns = ["job_id", "event_id", "ts", "status"]
    relevant = events.where(F.col("status").isin("Failed", *J.REARMING)).select(*columns)

    def report(before: DataFrame | None, batch: DataFrame, current: DataFrame, epoch: int) -> None:
        rows = _after(before, batch).withColumn("_ts", F.unix_micros(F.col("ts").cast("timestamp")))
        stretch = F.floor(F.col("_ts") / (bucket_seconds * 1_000_000))
        # What is remembered comes first, whatever its time.
        bucket = F.when(F.col("arrival") == 1, F.coalesce(stretch, F.lit(FIRST + 1))).otherwise(F.lit(FIRST))
        seen = previous_by_bucket(rows, ["job_id"], ["arrival", "_ts", "event_id"], "status", "_before", bucket)
        alert = (F.col("arrival") == 1) & J.is_alert(F.col("_before"))
        seen.where(alert).select("job_id", "event_id", "ts").write.mode("overwrite").parquet(batch_folder(folder, epoch))

    def last(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        at = F.struct("arrival", "ts", "event_id")
        newest = _after(before, batch).groupBy("job_id").agg(F.max_by(F.struct("event_id", "ts", "status"), at).alias("e"))
        return newest.select("job_id", "e.*")

    return _fold(relevant, state, checkpoint, last, report)


def stream_outcomes(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """State of each job under the cancel rule: the first result stands until the job is queued again.

    The outcome so far stands in front of the events of a batch like an event of its own.
    """

    def settle(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = _after(before, batch)
        at = F.struct("arrival", "ts", "event_id")
        return J.settled(rows, at).join(
            rows.groupBy("job_id").agg(F.max_by(F.struct("event_id", "ts"), at).alias("e")), "job_id"
        ).select("job_id", "e.*", "status")

    return _fold(events.select("job_id", "event_id", "ts", "status"), folder, checkpoint, settle)


def stream_arrivals(files: DataFrame, folder: str, checkpoint: str, output_mode: str = "same_folder") -> StreamingQuery:
    """New files become queued jobs, each file once."""
    ready = files.select(
        F.xxhash64("path").alias("file_id"), "path", "length", F.lit(output_mode).alias("output_mode"),
        F.lit(None).cast("string").alias("custom_folder"), F.lit(False).alias("preserve_structure"),
        F.lit("").alias("template"), F.lit(None).cast("string").alias("target_extension"),
    )
    queued = J.enqueue(ready).where("issue IS NULL").drop("issue")
    return _write_epochs(queued, folder, checkpoint, "append")


def stream_recent_logs(logs: DataFrame, folder: str, checkpoint: str, n: int = LOGS_KEEP) -> StreamingQuery:
    """Keep the newest log rows: each batch merges its rows with the last kept ones."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if epoch > 0:
            merged = batch.unionByName(spark.read.parquet(batch_folder(folder, epoch - 1)))
        recent_logs(merged, n).write.mode("overwrite").parquet(batch_folder(folder, epoch))

    return (
        logs.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
