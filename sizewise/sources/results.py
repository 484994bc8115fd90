"""Measured encodes kept by their key, so that later runs measure only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sizewise.session import deal

#: Hash partitions of a store; a run reads those that hold its keys.
BUCKETS = 32
KEY = ["image_id", "encode_key"]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")


def read_results(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All kept results: ``image_id``, ``encode_key`` and the columns of ``schema``; none if there is no store yet.

    A key that two runs measured at the same time has one row, since equal keys give equal bytes.
    """
    full = f"image_id long, encode_key string, {schema}, bucket int"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(store)


def measure_once(
    keyed: DataFrame, store: str, schema: str, measure: Callable[[DataFrame], DataFrame], waves: int = 1, buckets: int = BUCKETS,
    tasks: int | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """The results of candidates (``image_id``, ``encode_key``, ...), measuring only keys that the store does not hold.

    ``measure`` takes one candidate per missing key and returns ``image_id``, ``encode_key`` and the columns of ``schema``. Missing keys
    are measured in ``waves`` by a hash, each appended to the store when it is done: a run that ends early leaves whole waves, and the next
    one goes on from there. Returns the candidates with their results, and how many keys were known and measured. Only the buckets of the
    keys are read; a failed measurement is kept like any other result.

    Candidates are read several times. A caller with many deals them by ``KEY`` to ``tasks``, persists them and names that number: then
    only what the store holds is shuffled, to meet them.
    """
    spark = keyed.sparkSession
    names = [f.strip().split()[0] for f in schema.split(",")]
    wanted = keyed.select(*KEY, _bucket(buckets)).distinct()
    counted = wanted.agg(F.collect_set("bucket").alias("buckets"), F.count(F.lit(1)).alias("n")).first()
    touched, total = sorted(counted["buckets"]), counted["n"]  # at most the number of buckets

    def kept() -> DataFrame:
        rows = read_results(spark, store, schema)
        return deal(rows.where(F.col("bucket").isin(touched)).drop("bucket"), tasks, *KEY)

    known = wanted.join(kept().select(*KEY), KEY, "left_semi").count()
    if known < total:
        for wave in range(waves):
            # What the store holds is looked up again, so that a wave never measures what another run has added.
            missing = wanted.join(kept().select(*KEY), KEY, "left_anti").where(F.pmod(F.xxhash64("encode_key", "image_id"), F.lit(waves)) == wave).select(*KEY)
            first = keyed.join(missing, KEY).groupBy(*KEY).agg(F.min_by(F.struct(*keyed.columns), "candidate_id").alias("c")).select("c.*")
            new = measure(first).select(*KEY, *names).withColumn("bucket", _bucket(buckets))
            new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(store)
    return keyed.join(kept().dropDuplicates(KEY), KEY, "left"), {"known": known, "measured": total - known}
