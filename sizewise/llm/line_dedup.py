"""Line deduplication over windows of three lines, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sizewise.session import cut_lineage

LINES = 3


def _windows(rows: DataFrame, lines: int) -> DataFrame:
    """One row per window of consecutive lines: its 128-bit hash, and where it begins."""
    def window(i: Column) -> Column:
        parts = [F.get(F.col("lines"), i + k) for k in range(lines)]
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    n = F.size("lines")
    every = F.when(n >= lines, F.transform(F.sequence(F.lit(0), n - lines), window))
    # The outer form, since the plain one would be given a filter that hashes all windows once more.
    out = rows.select("id", "text_hash", F.explode_outer(every).alias("w")).where("w IS NOT NULL")
    return out.select("id", "text_hash", "w.pos", "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, id_col: str = "log_id", text_col: str = "message", lines: int = LINES) -> DataFrame:
    """Removes lines that repeat earlier lines in windows of ``lines`` consecutive lines.

    Runs on exported log texts (``log_id``, ``message``) as on any table of texts. Lines are split at ``\\n`` and compared
    as they are. Windows are ordered by id, then by the hash of the text where ids repeat, then by position; the first
    occurrence of a window anywhere stays, each later one marks its lines, and marked lines go. Windows are judged on the
    input, not on what is left. Returns all columns of ``docs``, with ``text_col`` cut, and ``n_lines``, ``n_removed``.

    First occurrences are minima combined before the shuffle; the windows then meet the few repeated ones in an ordinary
    join, whose hot keys adaptive execution splits.

    A null text stays null and has no lines; an empty text is one empty line. Texts of fewer lines have no window and stay.
    Rows that repeat both id and text are one text given twice and lose the same lines. A null id comes before all others.
    Columns of ``docs`` named like the two counts are replaced.
    """
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                        F.split(F.col(text_col), "\n", -1).alias("lines"))
    windows = _windows(split, lines)
    place = F.struct("id", "text_hash", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = cut_lineage(first.where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    later = windows.join(repeated, ["h1", "h2"]).where(~F.struct("id", "text_hash", "pos").eqNullSafe(F.col("first")))
    marked = later.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("_marked")).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "_marked")

    rows = docs.drop("n_lines", "n_removed")
    names = rows.columns
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash"))
    both = rows.join(marked, same, "left").withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    covered = F.flatten(F.transform("_marked", lambda p: F.array(*[p + k for k in range(lines)])))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    both = both.withColumn("_left", F.when(F.col("_marked").isNotNull(), left))
    cut = F.when(F.col("_left").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n"))
    n_lines = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("_lines")), F.lit(0)).cast("long")
    removed = F.coalesce(F.size("_lines") - F.when(F.col("_left").isNotNull(), F.size("_left")), F.lit(0)).cast("long")
    return both.select(*[cut.alias(c) if c == text_col else F.col(c) for c in names], n_lines.alias("n_lines"),
                       removed.alias("n_removed"))
