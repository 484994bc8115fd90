"""Run history, profile catalogues, logs and decisions as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizewise.plans.reports import HISTORY_KEEP, log_lines, newest
from sizewise.session import spread

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("files_processed", T.LongType()),
        T.StructField("files_failed", T.LongType()),
        T.StructField("profile_name", T.StringType()),
        T.StructField("original_size", T.LongType()),
        T.StructField("output_size", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

PROFILE_KINDS = ["Web", "Lossless", "Custom"]
CATALOG_SCHEMA = "profiles ARRAY<STRUCT<name: STRING, kind: STRING, jpeg_quality: INT, webp_quality: INT, avif_quality: INT, metadata_mode: STRING>>, default_name STRING"


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All readable runs. Blank and broken lines, and lines without an id or a time, are skipped."""
    rows = spark.read.schema(HISTORY_SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(F.col("id").isNotNull() & F.col("timestamp").isNotNull())


def latest_history(spark: SparkSession, folder: str, n: int = HISTORY_KEEP) -> DataFrame:
    return newest(read_history(spark, folder), n)


def append_history(rows: DataFrame, folder: str) -> None:
    """Append runs. A missing time becomes now, a missing id a number made of the run, its place and the time."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.coalesce(F.nullif(F.col("timestamp").cast("string"), F.lit("")), now)
    given = F.col("id") if "id" in rows.columns else F.lit(None)
    made = F.pmod(F.xxhash64(*rows.columns, F.unix_micros(F.current_timestamp()), F.monotonically_increasing_id()), F.lit(1 << 62))
    rows.withColumn("id", F.coalesce(given.cast("long"), made)).withColumn("timestamp", at).write.mode("append").json(folder)


def compact_history(spark: SparkSession, folder: str, target: str, n: int = HISTORY_KEEP) -> None:
    """Write the newest runs, oldest first, to a new folder. The bound makes one ordered file small."""
    newest(read_history(spark, folder), n).orderBy("timestamp", "id").write.mode("overwrite").json(target)


def remove_history(spark: SparkSession, folder: str, target: str, ids: DataFrame) -> None:
    """Write the history without the runs in ``ids`` (id) to a new folder."""
    read_history(spark, folder).join(ids.select("id"), "id", "left_anti").write.mode("overwrite").json(target)


def clear_history(spark: SparkSession, target: str) -> None:
    spark.createDataFrame([], HISTORY_SCHEMA).write.mode("overwrite").json(target)


def write_documents(documents: DataFrame, key: str, text: str, folder: str) -> None:
    """Write each document to a file of its own in one folder; one that comes several times under a key is written once.

    Files are moved to their place by the tasks that write them, not one by one by the driver.
    """
    single = spread(documents.select(key, text), key).dropDuplicates([key])
    writer = single.select(text).write.mode("errorifexists").option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


def read_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Profile catalogues, one JSON document per file, leniently.

    Profiles of an unknown kind are dropped. A default that names no profile falls back to Web. A document that
    cannot be read at all gives a row with ``profiles`` NULL: the built-in presets stand in for it.
    """
    documents = spark.read.text(folder, wholetext=True).select(
        F.input_file_name().alias("path"), F.from_json("value", CATALOG_SCHEMA).alias("c")
    )
    known = F.filter("c.profiles", lambda p: p["kind"].isin(PROFILE_KINDS))
    default = F.coalesce(F.col("c.default_name"), F.lit("Web"))
    valid = F.exists("profiles", lambda p: p["name"] == F.col("wanted_default"))
    return (
        documents.select("path", known.alias("profiles"), default.alias("wanted_default"))
        .withColumn("default_name", F.when(valid, F.col("wanted_default")).otherwise("Web"))
        .drop("wanted_default")
    )


def catalog_profiles(catalogs: DataFrame) -> DataFrame:
    return catalogs.select("path", "default_name", F.explode("profiles").alias("p")).select(
        "path", "p.*", (F.col("p.name") == F.col("default_name")).alias("is_default")
    )


def set_default(catalogs: DataFrame, name: Column) -> DataFrame:
    """Choose a default by name, ignoring case; catalogues without such a profile keep theirs."""
    found = F.exists("profiles", lambda p: F.lower(p["name"]) == F.lower(name))
    return catalogs.withColumn("default_name", F.when(found, name).otherwise(F.col("default_name")))


def export_logs(logs: DataFrame, folder: str) -> None:
    """Log rows as text lines in time order; a range-partitioned sort, so the files follow each other."""
    log_lines(logs.orderBy("ts", "log_id")).select("line").write.mode("errorifexists").text(folder)


def write_decisions(decisions: DataFrame, folder: str) -> None:
    """Publish decisions. An existing result is never overwritten; the commit protocol hides partial output."""
    decisions.write.mode("errorifexists").parquet(folder)
