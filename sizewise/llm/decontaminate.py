"""Benchmark decontamination with a broadcast set of normalised word windows, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sizewise.llm.common import ascii_lower

#: Everything that is no word character, after lower-casing A-Z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of the benchmark that one broadcast may hold, at most; the rest go in further slices.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _window_keys(hashes: Column, n: Column, length: int) -> Column:
    def key(i: Column) -> Column:
        return F.xxhash64(F.lit(length), *[F.get(hashes, i + k) for k in range(length)])

    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), key)).otherwise(
        F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """The distinct windows of a benchmark: ``key``, ``length``, ``window`` (its words) and ``items`` (their ids)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    length = F.least(n, F.lit(window))
    starts = words.where(n > 0).select(
        "item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), n - length)).alias("i"))
    cut = starts.select("item", "length", F.slice("words", F.col("i") + 1, F.col("length")).alias("window"))
    found = cut.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashes = F.transform("window", lambda w: F.xxhash64(w))
    keys = [F.when(F.col("length") == k, F.xxhash64(F.lit(k), *[F.get(hashes, F.lit(j)) for j in range(k)]))
            for k in range(1, window + 1)]
    return found.withColumn("key", F.coalesce(*keys))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "log_id", text_col: str = "message",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Which words of each text lie in a window of words of a benchmark.

    Runs on exported log messages (``log_id``, ``message``) as on any table of texts. Returns ``id_col``, ``text_hash``
    (tells rows with one id apart), ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``item_ids`` (sorted as strings), ``spans`` (array of start, end; word positions, end excluded, as found) and
    ``contaminated``.

    Texts and windows are hashed over their normalised words; the windows are broadcast in slices of a checked size,
    and each match of a hash is confirmed on the words themselves. The words stay in the scanning task: only hits and
    one small row per text are shuffled. A benchmark without words hits nothing.

    Null and empty texts have no words. Rows that repeat both id and text give one row; rows with one id and other
    texts, or with a null id, are texts of their own. Items that repeat count once per id; items with a null id are
    left out of the ids but their windows hit. Further columns are ignored.
    """
    windows = item_windows(items, item_id_col, item_text_col, window)
    sizes = windows.groupBy("length").count().collect()  # at most ``window`` rows
    lengths = sorted(r["length"] for r in sizes) or [window]
    slices = max(1, -(-sum(r["count"] for r in sizes) // broadcast_windows))

    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                        words_of(F.col(text_col)).alias("words"))
    words = words.withColumn("n", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # One key per window of each length, then a null that keeps the text itself.
    keys = F.concat(*[_window_keys(F.col("hashes"), F.col("n"), k) for k in lengths],
                    F.array(F.lit(None).cast("bigint")))
    keyed = words.select("id", "text_hash", "words", "n", keys.alias("keys"))

    # The outer form, since the plain one would be given a filter that computes all keys once more.
    places = keyed.select("id", "text_hash", "words", "n", F.posexplode_outer("keys").alias("p", "k"))
    blocks, before = [], F.lit(0)  # the windows of each length follow one another
    for k in lengths:
        blocks.append((before, k))
        before = before + F.greatest(F.col("n") - k + 1, F.lit(0))
    start = F.coalesce(*[F.when(F.col("p") >= b, F.col("p") - b) for b, _ in reversed(blocks)]).cast("int")
    length = F.coalesce(*[F.when(F.col("p") >= b, F.lit(k)) for b, k in reversed(blocks)])

    parts = []
    for s in range(slices):
        some = windows.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == s) if slices > 1 else windows
        some = F.broadcast(some.select(F.col("key").alias("wk"), F.col("length").alias("wl"), "window", "items"))
        same = (F.col("k") == F.col("wk")) & (length == F.col("wl")) & (
            F.slice("words", start + 1, F.col("wl")) == F.col("window"))
        found = places.join(some, same, "left").where("k IS NULL OR wk IS NOT NULL")
        parts.append(found.select("id", "text_hash", "n", F.when(F.col("wk").isNotNull(), F.struct(
            start.alias("start"), (start + length).alias("end"))).alias("span"), "items"))
    hits = reduce(DataFrame.unionByName, parts)
    per_text = hits.groupBy("id", "text_hash", F.col("n").cast("long").alias("n_words")).agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("int").alias("to")),
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).cast("long").alias("hit"),
            F.greatest(acc["to"], x["end"]).alias("to")))
    return per_text.select(F.col("id").alias(id_col), "text_hash", "n_words", covered["hit"].alias("n_hit"),
                           F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans",
                           (covered["hit"] > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "log_id", text_col: str = "message",
                         **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    bad = contamination(docs, items, id_col, text_col, **options).where("contaminated")
    bad = bad.select(F.col(id_col).alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("_bad_hash"))
    return docs.join(bad, same, "left_anti")
