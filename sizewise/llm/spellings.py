"""Spelling variants of words, found by a dictionary of pairs of trie nodes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.llm.common import ascii_lower, staged

#: Runs of these letters, lower-cased, are words. Ninety letters: the bound of a group of words that differ in one place.
LETTERS = r"([a-zÀ-ÿ]+)"
#: One in so many runs of a text has lost a letter, told by a checksum of the text's id and the run.
SLIP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words numbered together, about, and letters of a bound between two such ranges.
RANGE_WORDS, BOUND_LETTERS = 50_000, 64
#: Candidates for bounds, per range.
BOUND_CHOICE = 64
#: A number tells the range in its upper part and counts in so many lower bits; numbers below are those of bounds.
LOCAL_BITS = 36


def written_words(requests: DataFrame, request_id: str = "request_id", prompt: str = "prompt") -> DataFrame:
    """The words of all prompts with their number ``n`` of occurrences, after the slips of the pen."""
    runs = requests.select(F.coalesce(F.col(request_id).cast("string"), F.lit("")).alias("id"),
                           F.explode(F.regexp_extract_all(ascii_lower(F.col(prompt)), F.lit(LETTERS), 1)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= LEAST_COUNT)


def bounds_of(words: DataFrame, ranges: int) -> list[str]:
    """Beginnings of words that part the words into about equal ranges of their order; at most ``ranges`` - 1."""
    if ranges < 2:
        return []
    chosen = words.orderBy(F.xxhash64("word"), "word").select(F.substring("word", 1, BOUND_LETTERS).alias("b")).limit(
        ranges * BOUND_CHOICE)  # bounded by the number of ranges
    found = sorted(r["b"] for r in chosen.collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)} - {""}) if found else []


class TrieNumbers:
    """Numbers for the nodes of a trie whose words lie in several ranges of their order.

    A node is a beginning of words. All words below it lie in one range, unless it is also a beginning of a bound; such nodes
    have fixed small numbers that every range knows. The other nodes are numbered within their range.
    """

    def __init__(self, bounds: list[str]):
        self.bounds = bounds
        self.fixed: dict[str, int] = {"": 0}
        for b in bounds:
            for k in range(1, len(b) + 1):
                self.fixed.setdefault(b[:k], len(self.fixed))

    def range_of(self, word: str) -> int:
        return bisect_right(self.bounds, word)

    def number(self, words: list[str], of_range: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each word of one range from the root on, ``len(word)`` + 1 of them, and where those of each word begin.

        ``words`` are sorted and distinct. The nodes of a depth are numbered along the words: a word opens a new one
        beyond the letters that it shares with the word before.
        """
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        begin = size.cumsum() - size
        spot = np.arange(len(letters)) - np.repeat(begin, size)
        before = np.repeat(np.concatenate([[0], begin[:-1]]), size) + spot
        known = (spot < np.repeat(np.concatenate([[0], size[:-1]]), size)) & (letters[np.minimum(before, len(letters) - 1)] == letters)
        shared = np.minimum.reduceat(np.where(known, np.repeat(size, size), spot), begin)
        depth = spot + 1
        new = depth > np.repeat(shared, size)
        order = np.argsort(depth, kind="stable")
        inner = np.empty(len(letters), np.int64)
        inner[order] = np.cumsum(new[order])
        inner += (of_range + 1) << LOCAL_BITS
        for b in (self.bounds[k] for k in (of_range - 1, of_range) if 0 <= k < len(self.bounds)):
            text = np.frombuffer(b.encode("utf-32-le"), np.uint32)
            same = (spot < len(text)) & (text[np.minimum(spot, len(text) - 1)] == letters)
            common = np.minimum.reduceat(np.where(same, np.repeat(size, size), spot), begin)
            fixed = np.array([self.fixed[b[:k]] for k in range(len(b) + 1)], np.int64)
            on = depth <= np.repeat(common, size)
            inner[on] = fixed[depth[on]]
        ends = np.concatenate([[0], (size + 1).cumsum()])
        out = np.zeros(ends[-1], np.int64)
        inside = np.ones(len(out), bool)
        inside[ends[:-1]] = False
        out[inside] = inner
        return out, ends


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that arrive ordered by ``range``, one table per range."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while len(batch):
            ranges = batch.column("range").to_numpy()
            if held and held[0].column("range")[0].as_py() != ranges[0]:
                yield pa.Table.from_batches(held)
                held = []
            n = int(np.searchsorted(ranges, ranges[0], side="right"))
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield pa.Table.from_batches(held)


def _dealt(words: DataFrame, numbers: TrieNumbers, column: str) -> DataFrame:
    """Words in ranges of their order, sorted, each range in one task."""
    fields = words.schema.fieldNames()

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([numbers.range_of(w) for w in batch.column(column).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([found, *[batch.column(f) for f in fields]], names=["range", *fields])

    schema = "range long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(ranged, schema).repartition(len(numbers.bounds) + 1, "range").sortWithinPartitions("range", column)


def node_pairs(words: DataFrame, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """The words with an ``id`` each, in code-point order, and the pair dictionary.

    The dictionary has for each word and place the forward node of what stands before and the backward node of what
    follows: with the letter at the place skipped (``role`` 1; 2 if it is the first of equal letters) and with a letter put in there (``role`` 0).
    """
    ranges = -(-words.count() // range_words)
    forward = TrieNumbers(bounds_of(words, ranges))

    def number_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_ranges(batches):
            k = rows.column("range")[0].as_py()
            nodes, ends = forward.number(rows.column("word").to_pylist(), k)
            ids = (np.int64(k) << LOCAL_BITS) + np.arange(len(rows))
            prefix = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(nodes)).cast(pa.list_(pa.int64()))
            table = pa.table({"id": pa.array(ids), "word": rows.column("word"), "n": rows.column("n"), "prefix": prefix})
            yield from table.to_batches(max_chunksize=10_000)

    numbered = staged(_dealt(words, forward, "word").mapInArrow(number_forward, "id long, word string, n long, prefix array<long>"))
    turned = numbered.select("id", F.reverse("word").alias("word"), "n", "prefix")
    backward = TrieNumbers(bounds_of(turned, ranges))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_ranges(batches):
            words = rows.column("word").to_pylist()
            suffix, ends = backward.number(words, rows.column("range")[0].as_py())
            prefix = pa.concat_arrays([c.flatten() for c in rows.column("prefix").chunks]).to_numpy()
            size = np.diff(ends)  # places of a word: one more than its letters
            of = np.repeat(np.arange(len(words)), size)
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
            behind = ends[1:][of] - 1 - place  # the node of the letters from this place on
            ids, n = (rows.column(c).to_numpy()[of] for c in ("id", "n"))
            letters = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le"), np.uint32)
            last = place == size[of] - 1
            first = np.ones(len(place), bool)
            spot = np.flatnonzero(~last)  # the letters of all words, in order
            first[spot[1:]] = (letters[1:] != letters[:-1]) | (place[spot[1:]] == 0)
            put = [prefix, suffix[behind], ids, n, np.zeros(len(place), np.int8)]
            skip = [prefix[spot], suffix[behind[spot] - 1], ids[spot], n[spot], np.where(first[spot], 2, 1).astype(np.int8)]
            columns = [np.concatenate(c) for c in zip(put, skip, strict=True)]
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000]) for c in columns], names=["p", "s", "id", "n", "role"])

    pairs = _dealt(turned, backward, "word").mapInArrow(pair, "p long, s long, id long, n long, role byte")
    return numbered.select("id", "word", "n"), pairs


def near_words(pairs: DataFrame) -> DataFrame:
    """Per word ``id``: ``n_near``, the number of words that differ in one letter put in, left out or replaced, and ``best``,
    of these the one of largest n (ties: smallest id) as ``n`` and minus ``id``. Words without any have no row.

    Words that share a pair where each skips a letter differ in that letter; words where one skips what the other puts in
    differ by it. A letter among equal ones is skipped for that at its first place only, so that no two words meet twice.
    A pair has at most as many members as there are letters, and one more.
    """
    rank = F.struct("n", (-F.col("id")).alias("minus_id"), "role")
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(rank), asc=False).alias("members")).where(F.size("members") > 1)
    skips = F.filter("members", lambda m: m["role"] > 0)
    firsts = F.filter("members", lambda m: m["role"] == 2)
    puts = F.filter("members", lambda m: m["role"] == 0)
    parts = groups.select("members", skips.alias("skips"), firsts.alias("firsts"), puts.alias("puts"))
    one = parts.select(F.explode("members").alias("m"), "skips", "firsts", "puts")
    other = F.when(F.get("skips", F.lit(0))["minus_id"] != F.col("m.minus_id"), F.get("skips", F.lit(0))).otherwise(F.get("skips", F.lit(1)))

    def ranked(m):
        return F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["minus_id"].alias("minus_id")))

    put = F.when(F.col("m.role") == 2, F.get("puts", F.lit(0)))
    is_put = F.col("m.role") == 0
    best = F.when(is_put, ranked(F.get("firsts", F.lit(0)))).otherwise(F.greatest(ranked(other), ranked(put)))
    count = F.when(is_put, F.size("firsts")).otherwise(F.size("skips") - 1 + F.when(F.col("m.role") == 2, F.size("puts")).otherwise(0))
    found = one.select((-F.col("m.minus_id")).alias("id"), count.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def group_spellings(requests: DataFrame, request_id: str = "request_id", prompt: str = "prompt",
                    range_words: int = RANGE_WORDS) -> DataFrame:
    """The words of goal prompts with the usual form of each.

    Runs on goal requests (``request_id``, ``prompt``) as on any table of texts. Words are maximal runs of ``[A-Za-z]`` and
    the letters U+00C0 to U+00FF with A-Z lower-cased; a run whose checksum with the request id is divisible by ``SLIP`` lost
    one letter. Words of fewer than five letters or three occurrences are left out. Returns per word: ``word``, ``form``
    (the near word of largest n, ties to the smallest, if it is at least twice as frequent; else null), ``root`` (the last form
    along the forms, the word itself if there is none), ``n``, ``n_near`` and ``form_n``.

    1. Words are counted, combined before the shuffle. 2. They are numbered in order, and so are the nodes of their trie and
    of the trie of the reversed words, range by range. 3. Each word lists pairs of nodes (beginning, end) for each letter
    skipped and each letter put in; near words are those that meet in a pair, exactly. 4. Forms are followed by doubling; as each is
    twice as frequent as the one before, the rounds follow from the largest count.

    A null prompt has no words; a null request id counts as an empty one. Repeated rows count again. Texts and runs are whole, however
    long; a run costs in proportion to its length. An empty table gives an empty result; further columns are ignored.
    """
    words = staged(written_words(requests, request_id, prompt))
    numbered, pairs = node_pairs(words, range_words)
    near = staged(near_words(pairs))
    joined = numbered.join(near, "id", "left")
    follows = F.col("best.n") >= 2 * F.col("n")
    told = staged(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(follows, -F.col("best.minus_id")).alias("form_id"), F.when(follows, F.col("best.n")).alias("form_n")))
    up = told.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id"))
    most = told.agg(F.max("n")).first()[0] or 1
    steps = 1
    while steps < most.bit_length():  # forms that can follow each other
        ahead = up.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        up = staged(up.join(ahead, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")))
        steps *= 2
    names = told.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    roots = up.join(told.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return told.join(names, "form_id", "left").join(roots, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
