"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str = "sizewise", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session to the library instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SIZEWISE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder; a cluster session without it is an error, since executors do not share a local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured or current:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured or current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    folder = tempfile.mkdtemp(prefix="sizewise-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and survive executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what is made once and read many times, in a fraction of the size of a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks that work is dealt to for each core that the session counts on.
TASKS_PER_CORE = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by the hash of their keys to several tasks per core, where each row is little to read and much work.

    Tasks are otherwise cut by bytes; a number that is given is not lowered by the adaptive planner.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows that one task sorts or groups, where their number is known.
ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks so many rows are dealt to; None if the cores of the session do, which leaves the number to the planner."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Deal rows by the hash of their keys to that many tasks: what one task holds then does not grow with the table."""
    return df if tasks is None else df.repartition(tasks, *keys)


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant dimension table as a LocalRelation, so its exact size is known to the optimizer."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
