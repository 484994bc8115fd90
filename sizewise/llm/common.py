"""Helpers of the corpus operators: reading tables, ASCII lower case, staged tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sizewise.session import checkpoint_dir

#: Pointers followed in one round of connected components.
JUMPS = 3
# Tables of ids compress so well in files that the planner takes them for small ones and would send them through the driver, several in one
# plan. Joins of what grows with the corpus name this method, so that no driver ever holds such a table.
ROW_JOIN = "merge"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def staged(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder.

    It survives lost executors and ends the plan. Unlike a checkpoint, whose size Spark still estimates from the plan
    behind it, a file has the size it has: loops of joins stay cheap to plan, and joins are chosen by true sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest id reachable from each id of an undirected graph.

    ``links`` has the columns ``a`` and ``b`` (long). Returns ``id`` and ``component`` for each id in a link; an id in
    no link has no row. Null ends are no links, an empty table gives an empty result.

    Each round points every id to the smallest id it is linked to, follows the pointers a few steps and draws the links
    between the ids reached; a hub takes one round, a chain shrinks to a quarter. Minima are combined before each shuffle
    and the links of a hub are dealt by an ordinary join, which adaptive execution can split; no round collects an id.
    Rounds are written to the shared folder.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = staged(both.distinct())
    rounds = []
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p"))
        up = staged(up)
        ahead = up.select(F.col("id").alias("p"), F.col("p").alias("next"))
        for _ in range(JUMPS):
            up = up.join(ahead.hint(ROW_JOIN), "p").select("id", F.col("next").alias("p"))
        up = staged(up)
        one = edges.join(up.select(F.col("id").alias("a"), F.col("p").alias("pa")).hint(ROW_JOIN), "a").select("pa", "b")
        two = one.join(up.select(F.col("id").alias("b"), F.col("p").alias("pb")).hint(ROW_JOIN), "b").where("pa <> pb")
        edges = staged(two.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        rounds.append(up)
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds[0].select("id", F.col("p").alias("component"))
    for up in rounds[1:]:
        moved = up.select(F.col("id").alias("component"), F.col("p").alias("q"))
        labels = labels.join(moved.hint(ROW_JOIN), "component", "left").select("id", F.coalesce("q", "component").alias("component"))
    return staged(labels) if len(rounds) > 1 else labels


def utf8(column) -> tuple:
    """The bytes of an Arrow string column, and where each value begins; a null is an empty value."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return (data[offsets[0]:offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))
