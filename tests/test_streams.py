"""Streams in several micro-batches against the batch result."""

import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise.plans import jobs, reports
from sizewise.sources import files
from sizewise.streaming import jobs as streams
from tests.png_files import png_bytes


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir, tmp_path_factory):
    """The event table cut into five files by time, read one file per micro-batch."""
    folder = tmp_path_factory.mktemp("events")
    events = D.read(spark, sf_dir, "events")
    rank = F.ntile(5).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))
    parts = events.withColumn("_part", rank)
    for i in range(1, 6):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(str(folder / f"p{i}"))
    return events.schema, str(folder)


def stream(spark, arrivals):
    schema, folder = arrivals
    raw = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").parquet(folder)
    )
    return D.as_job_events(raw)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_latest_status(spark, sf_dir, arrivals, tmp_path):
    streams.stream_latest_status(stream(spark, arrivals), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "heads")).select("epoch").distinct().count() == 5
    got = streams.current_state(spark, str(tmp_path / "out"))
    expected = jobs.latest_status(D.job_events(spark, sf_dir))
    assert rows_of(got, "job_id", "event_id", "status") == rows_of(expected, "job_id", "event_id", "status")


def test_alerts(spark, sf_dir, arrivals, tmp_path):
    streams.stream_alerts(stream(spark, arrivals), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(got, "job_id", "event_id") == rows_of(jobs.job_alerts(D.job_events(spark, sf_dir)), "job_id", "event_id")


def test_outcomes(spark, sf_dir, arrivals, tmp_path):
    streams.stream_outcomes(stream(spark, arrivals), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.current_state(spark, str(tmp_path / "out"))
    assert rows_of(got, "job_id", "status") == rows_of(jobs.job_outcome(D.job_events(spark, sf_dir)), "job_id", "status")


def test_cancel_wins(spark):
    events = [(1, 1, "Queued"), (1, 2, "Processing"), (1, 3, "Cancelled"), (1, 4, "Completed"), (2, 5, "Queued"), (2, 6, "Completed"),
              (2, 7, "Cancelled"), (3, 8, "Failed"), (3, 9, "Queued"), (4, 10, "Queued"), (4, 11, "Processing")]
    df = spark.createDataFrame(events, "job_id long, event_id long, status string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.job_id: r.status for r in jobs.job_outcome(df).collect()}
    assert got == {1: "Cancelled", 2: "Completed", 3: "Queued", 4: "Processing"}


def test_queue_stats(spark, sf_dir, arrivals, tmp_path):
    streams.stream_queue_stats(stream(spark, arrivals), str(tmp_path / "jobs"), str(tmp_path / "stats"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "stats")).orderBy(F.desc("epoch")).drop("epoch").first()
    assert last == jobs.queue_stats(jobs.latest_status(D.job_events(spark, sf_dir))).first()


def test_recent_logs(spark, sf_dir, arrivals, tmp_path):
    schema, folder = arrivals
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    rows = raw.select("ts", F.col("event_id").alias("log_id"))
    streams.stream_recent_logs(rows, str(tmp_path / "out"), str(tmp_path / "cp"), 40).awaitTermination()
    kept = spark.read.parquet(streams.batch_folder(str(tmp_path / "out"), 4))
    expected = reports.recent_logs(D.read(spark, sf_dir, "events").select("ts", F.col("event_id").alias("log_id")), 40)
    assert rows_of(kept, "log_id") == rows_of(expected, "log_id")


def test_a_hot_job_over_several_batches_and_a_folder_of_parts(spark, tmp_path):
    kinds = ["Queued", "Processing", "Failed", "Cancelled", "Completed", "Failed"]
    rows = [(1 if i % 3 else i, i, kinds[(i * 7 + i // 5) % 6]) for i in range(900)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, status string").withColumn("ts", F.timestamp_seconds(F.floor(F.col("event_id") / 4)))
    for i in range(3):
        df.where(F.floor(F.col("event_id") / 300) == i).coalesce(1).write.parquet(str(tmp_path / "events.parquet" / f"p{i}"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "events.parque[t]"))
    streams.stream_alerts(read(), str(tmp_path / "s1"), str(tmp_path / "alerts"), str(tmp_path / "c1")).awaitTermination()
    streams.stream_outcomes(read(), str(tmp_path / "s2"), str(tmp_path / "c2")).awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "alerts")), "job_id", "event_id") == rows_of(jobs.job_alerts(df), "job_id", "event_id")
    assert rows_of(streams.current_state(spark, str(tmp_path / "s2")), "job_id", "status") == rows_of(jobs.job_outcome(df), "job_id", "status")


def test_arrivals_become_jobs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png_bytes(bytes(16), 2, 2))
    (tmp_path / "in" / "b.txt").write_text("no")
    run = lambda: streams.stream_arrivals(files.stream_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "c.JPG").write_bytes(b"x")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.input_format, r.destination.rsplit("/", 1)[1]) for r in got.collect()) == [
        ("JPEG", "c_optimized.JPG"), ("PNG", "a_optimized.png")]


def _arrive(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "job_id long, event_id long, status string, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(str(folder / name))
    return df.schema


def _read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_a_batch_rewrites_the_buckets_of_its_own_jobs(spark, tmp_path):
    run = lambda: streams.stream_latest_status(_read(spark, tmp_path / "in", schema), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    schema = _arrive(spark, tmp_path / "in", "a", [(j, j, "Queued", 10) for j in range(1000)])
    run()
    _arrive(spark, tmp_path / "in", "b", [(5, 2000, "Failed", 20), (5, 2001, "Completed", 21)])
    run()
    _arrive(spark, tmp_path / "in", "c", [(5, 3000, "Queued", 30), (7, 3001, "Cancelled", 31)])
    run()
    written = lambda epoch: [p for p in (tmp_path / "s" / "rows" / f"epoch={epoch}").glob("bucket=*") if any(p.iterdir())]
    # Of the first epoch only what the last two epochs name is left; the others wrote a bucket or two.
    assert len(written(1)) == 1 and len(written(2)) in (1, 2) and len(written(0)) == streams.BUCKETS - 1
    state = {r.job_id: (r.status, r.event_id) for r in streams.current_state(spark, str(tmp_path / "s")).collect()}
    assert len(state) == 1000 and state[5] == ("Queued", 3000) and state[7] == ("Cancelled", 3001) and state[8] == ("Queued", 8)


def test_a_replayed_batch_changes_nothing_and_foreign_state_is_refused(spark, tmp_path):
    schema = _arrive(spark, tmp_path / "in", "a", [(1, 1, "Failed", 10), (2, 2, "Queued", 11)])
    run = lambda c: streams.stream_alerts(_read(spark, tmp_path / "in", schema), str(tmp_path / "s"), str(tmp_path / "out"), str(tmp_path / c)).awaitTermination()
    run("c")
    _arrive(spark, tmp_path / "in", "b", [(1, 3, "Failed", 20), (2, 4, "Failed", 21)])
    run("c")
    # The commit of the last batch is lost: it runs again.
    for f in (tmp_path / "c" / "commits").glob("*1*"):
        f.unlink()
    run("c")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "job_id", "event_id") == [(1, 1), (2, 4)]
    with pytest.raises(Exception, match="another checkpoint"):
        run("fresh")


def test_finished_jobs_expire_and_late_events_do_not_bring_them_back(spark, tmp_path):
    run = lambda: streams.stream_latest_status(_read(spark, tmp_path / "in", schema), str(tmp_path / "s"), str(tmp_path / "c"), expire_seconds=100).awaitTermination()
    schema = _arrive(spark, tmp_path / "in", "a", [(1, 1, "Completed", 10), (2, 2, "Queued", 10), (3, 3, "Failed", 90)])
    run()
    _arrive(spark, tmp_path / "in", "b", [(4, 4, "Queued", 150), (1, 5, "Queued", 5)])
    run()
    state = lambda: {r.job_id: r.status for r in streams.current_state(spark, str(tmp_path / "s"), 100).collect()}
    assert state() == {2: "Queued", 3: "Failed", 4: "Queued"}
    _arrive(spark, tmp_path / "in", "d", [(3, 6, "Completed", 60), (2, 7, "Cancelled", 160)])  # the first is older than what is known
    run()
    assert state() == {2: "Cancelled", 3: "Failed", 4: "Queued"}
