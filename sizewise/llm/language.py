"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizewise.llm.common import utf8

#: Bytes of context. A gram is a byte with its context, so it has one byte more; four fit an unsigned 32-bit number.
ORDER = 3
#: Texts per language that the model is fitted on, about.
TEXTS_PER_LANGUAGE = 400
#: What stands before the first byte of a text, as context only.
BEFORE = b"\n" * ORDER
UNKNOWN = "und"


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram ending at each byte of texts laid out one after another, and where the grams of each text begin and end."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] + ORDER * np.arange(1, len(lengths) + 1)
    padded = np.full(len(data) + ORDER * len(lengths), BEFORE[0], dtype=np.uint32)
    padded[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)] = data
    grams = padded.copy()
    for k in range(1, ORDER + 1):
        grams[k:] |= padded[:-k] << np.uint32(8 * k)
    return grams, starts, starts + lengths


class ContextTree:
    """The contexts of up to ORDER bytes in the training text of one language, with frozen counts.

    A byte seen c times after a context of n bytes and t distinct ones has probability c / (n + t) there; the escape to
    the next shorter context has t / (n + t). Contexts never seen cost nothing to skip; below the empty context all bytes
    are equally likely.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            mask = np.uint32((1 << (8 * (k + 1))) - 1)
            keys, at = np.unique(grams & mask, return_inverse=True)
            seen = np.bincount(at, weights=counts)
            contexts, at = np.unique(keys >> np.uint32(8), return_inverse=True)
            self.levels.append((mask, keys, seen, contexts, np.bincount(at, weights=seen), np.bincount(at)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The exact code length of the last byte of each gram in its context."""
        total, going = np.zeros(len(grams)), np.arange(len(grams))
        for mask, keys, seen, contexts, n, t in self.levels:
            key = grams[going] & mask
            context = key >> np.uint32(8)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[c] == context
            s = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[s] == key
            cost = np.where(hit, np.log2((n[c] + t[c]) / seen[s]), np.where(known, np.log2((n[c] + t[c]) / t[c]), 0.0))
            total[going] += cost
            going = going[~hit]
        total[going] += 8.0
        return total


class LanguageModel:
    """Code lengths of all grams that training saw, for every language, behind a hash table; others are worked out."""

    def __init__(self, languages: list[str], trees: list[ContextTree], grams: np.ndarray):
        self.languages, self.trees = languages, trees
        self.costs = np.stack([t.bits(grams) for t in trees], axis=1).astype(np.float32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(grams)) * 4))))
        self.shift, self.slot_mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(grams), dtype=np.int32)
        slot = self._slot(grams)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            placed = self.slots[slot] == left
            left, slot = left[~placed], (slot[~placed] + np.uint32(1)) & self.slot_mask
        self.grams = grams

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435769)) >> self.shift

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The row of each gram in ``costs``, or -1."""
        slot = self._slot(grams)
        row = self.slots[slot]
        other = np.flatnonzero((row >= 0) & (self.grams[row] != grams))
        for _ in range(self.probes):
            if not len(other):
                break
            slot[other] = (slot[other] + np.uint32(1)) & self.slot_mask
            row[other] = self.slots[slot[other]]
            other = other[(row[other] >= 0) & (self.grams[row[other]] != grams[other])]
        row[other] = -1
        return row

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        room = max(1 << 16, (1 << 23) // len(self.languages))
        grams, starts, ends = grams_of(data, offsets)
        for at in range(0, len(grams), room):  # a slice may cut a text: its sums add up
            part = grams[at:at + room]
            lo, hi = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + len(part), side="left")
            row = self.rows(part)
            cost = self.costs[row]
            new = np.flatnonzero(row < 0)
            if len(new):
                distinct, back = np.unique(part[new], return_inverse=True)
                cost[new] = np.stack([t.bits(distinct) for t in self.trees], axis=1)[back]
            begin, end = np.clip(starts[lo:hi] - at, 0, len(part)), np.clip(ends[lo:hi] - at, 0, len(part))
            some = np.flatnonzero(end > begin)
            if len(some):
                cuts = np.stack([begin[some], end[some]], axis=1).ravel()
                cost = np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
                out[lo + some] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]
        return out


def fit_languages(texts: DataFrame, text_col: str = "prompt", lang_col: str = "lang", id_col: str = "prompt_id",
                  texts_per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel | None:
    """Fits context trees on a sample of about ``texts_per_language`` whole texts of each language, drawn by a hash.

    Rows without text or language are left out. Gram counts are taken on the executors; their sums, bounded by the bytes
    of the sample, come to the driver. None if nothing is labelled.
    """
    labelled = texts.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, texts_per_language / n)))])
    share = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = labelled.where(share < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offsets = utf8(batch.column("text"))
            for lang in sorted(set(langs)):
                for i in [i for i, x in enumerate(langs) if x == lang]:
                    one = data[offsets[i]:offsets[i + 1]]
                    grams, starts, ends = grams_of(one, np.array([0, len(one)]))
                    keys, n = np.unique(grams[starts[0]:ends[0]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys.astype(np.int64), "n": n})

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    trees = []
    for lang in languages:
        own = rows[rows["lang"] == lang].sort_values("gram")
        trees.append(ContextTree(own["gram"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(np.float64)))
    return LanguageModel(languages, trees, np.unique(rows["gram"].to_numpy().astype(np.uint32)))


def detect_language(texts: DataFrame, training: DataFrame, text_col: str = "prompt", lang_col: str = "lang",
                    id_col: str = "prompt_id", texts_per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to all columns of ``texts``.

    Runs on goal prompts (``prompt_id``, ``prompt``) as on any table of texts. Each language of ``training`` gets a tree of
    byte contexts of up to three bytes. A whole text is coded by each of them under frozen counts; the language with the
    shortest code wins, on a tie the first by name. ``score`` is its share of the probability that all languages give the text.

    A text that is null or has no letter, and every text if ``training`` has no labelled one, is ``und`` with score 0. Ids
    only draw the sample. Repeated rows get equal answers; columns named like the two results are replaced.
    """
    model = fit_languages(training, text_col, lang_col, id_col, texts_per_language)
    rows = texts.drop("lang_pred", "score", "_letters").withColumn(
        "_letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = [c for c in rows.columns if c != "_letters"]
    if model is None:
        return rows.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(shared.value.languages + [UNKNOWN], dtype=object)
        for batch in batches:
            bits = shared.value.code_lengths(*utf8(batch.column(text_col)))
            best = bits.argmin(axis=1)
            shares = 1.0 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0.0)).sum(axis=1)
            letters = np.asarray(batch.column("_letters").to_pylist(), dtype=bool)
            columns = [batch.column(c) for c in names]
            columns += [pa.array(languages[np.where(letters, best, -1)], pa.string()),
                        pa.array(np.where(letters, shares, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    schema = rows.drop("_letters").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(predict, schema)
