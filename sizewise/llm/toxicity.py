"""Toxicity by classifier chains over word features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from sizewise.llm.common import staged

#: Labelled texts that the chain is fitted on, and those that words are counted in to choose features, at most.
TRAINING_TEXTS, COUNTED_TEXTS = 10_000, 40_000
#: Words and stems that tell a category apart: how many for each, in how many texts of it each stands at least, and how much more often
#: than usual its texts are of the category. Common words would add up to a bias in long texts.
WORDS, WORD_TEXTS, WORD_LIFT = 400, 3, 3.0
#: How many words may be chosen though they tell nothing: of many rare ones, some stand in texts of one kind by chance.
CHANCE_WORDS = 1.0
#: Column of the number of labels that a drawn one stands for.
WEIGHT = "_weight"
FOLDS = 5
#: A text is rejected from this probability on. Log odds are shifted so that it parts out-of-fold texts best, where a text of the
#: category counts as much as so many others, as shares of each.
THRESHOLD, OTHERS_WEIGHT = 0.5, 4.0
WORD = re.compile(r"[^\W\d_]+")
#: Words also count by these numbers of first letters, so that inflected and compound forms are known by their stem.
STEMS = (4, 5, 6)
#: Words whose features a worker remembers.
REMEMBERED = 200_000


class LinearModel:
    """Logistic regression with an L2 penalty, fitted by Newton steps; the rows of a bounded sample are held densely."""

    def __init__(self, width: int, penalty: float = 0.02, steps: int = 30):
        self.weights, self.bias, self.penalty, self.steps = np.zeros(width), 0.0, penalty, steps

    def fit(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray,
            weight: np.ndarray | None = None) -> LinearModel:
        n, width = len(y), len(self.weights)
        weight = np.ones(n) if weight is None else weight
        x = np.zeros((n, width + 1))
        x[rows, cols] = values
        x[:, width] = 1.0
        penalty = np.append(np.full(width, self.penalty), 1e-6)
        w = np.zeros(width + 1)

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float(weight @ (np.logaddexp(0.0, z) - z * y) + 0.5 * (penalty * w * w).sum())

        now = loss(w)
        for _ in range(self.steps):
            p = _sigmoid(x @ w)
            hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty * w)
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            before, now = now, loss(w)
            if before - now < 1e-7 * max(1.0, abs(now)):
                break
        self.weights, self.bias = w[:width], float(w[width])
        return self

    def predict(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return _sigmoid(np.bincount(rows, weights=values * self.weights[cols], minlength=n) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _best_cut(odds: np.ndarray, of_category: np.ndarray, weight: np.ndarray) -> float:
    """The log odds that part texts of the category from others with the least loss of shares, in the middle of the gap; 0 without both."""
    if of_category.all() or not of_category.any():
        return 0.0
    order = np.argsort(-odds, kind="stable")
    value, yes = odds[order], of_category[order]
    caught = np.cumsum(weight[order] * yes) / (weight * of_category).sum()
    lost = np.cumsum(weight[order] * ~yes) / (weight * ~of_category).sum()
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True))  # equal odds go together
    best = int(np.argmax((caught - OTHERS_WEIGHT * lost)[ends]))
    after = value[ends[best] + 1] if ends[best] + 1 < len(value) else value[ends[best]] - 2.0
    return float((value[ends[best]] + max(after, value[ends[best]] - 4.0)) / 2)


class ClassifierChain:
    """One linear model per category, in order; each also sees the probabilities of the categories before it."""

    def __init__(self, vocabulary: dict[str, int], categories: list[str]):
        self.vocabulary, self.categories = vocabulary, categories
        self.models: list[LinearModel] = []
        self.shift = 0.0
        self.remembered: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        keys = [word, *["^" + word[:k] for k in STEMS if len(word) > k]]
        found = tuple(self.vocabulary[k] for k in keys if k in self.vocabulary)
        if len(self.remembered) >= REMEMBERED:
            self.remembered.clear()
        self.remembered[word] = found
        return found

    def count(self, text: str | None) -> Counter:
        """How often each feature occurs in a whole text."""
        out: Counter = Counter()
        known = self.remembered
        for word in WORD.findall((text or "").lower()):
            found = known.get(word)
            if found is None:
                found = self._of_word(word)
            for f in found:
                out[f] += 1
        return out

    def features(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols, values = [], [], []
        for i, text in enumerate(texts):
            found = self.count(text)
            rows += [i] * len(found)
            cols += found.keys()
            values += found.values()
        return np.array(rows, np.int64), np.array(cols, np.int64), 1.0 + np.log(np.array(values, np.float64))

    def _with(self, x: tuple, earlier: list[np.ndarray]) -> tuple:
        """Earlier probabilities as further features, on the scale of log odds."""
        rows, cols, values = x
        for k, p in enumerate(earlier):
            p = np.clip(p, 0.01, 0.99)
            rows = np.concatenate([rows, np.arange(len(p))])
            cols = np.concatenate([cols, np.full(len(p), len(self.vocabulary) + k)])
            values = np.concatenate([values, np.log(p / (1 - p)) / 4])
        return rows, cols, values

    def fit(self, x: tuple, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None) -> ClassifierChain:
        """``labels``: a column of 0 and 1 per category; ``weight``: how many texts each stands for. A later model is trained on probabilities that earlier ones gave
        for texts outside their own training folds."""
        earlier: list[np.ndarray] = []
        n = len(labels)
        weight = np.ones(n) if weight is None else weight
        for k in range(len(self.categories)):
            rows, cols, values = self._with(x, earlier)
            width = len(self.vocabulary) + k
            held_out = np.zeros(n)
            for f in range(FOLDS):
                used = fold[rows] != f
                place = np.cumsum(fold != f) - 1
                model = LinearModel(width).fit(place[rows[used]], cols[used], values[used], labels[fold != f, k],
                                               weight[fold != f])
                held_out = np.where(fold == f, model.predict(rows, cols, values, n), held_out)
            self.models.append(LinearModel(width).fit(rows, cols, values, labels[:, k], weight))
            earlier.append(held_out)
        self.shift = _best_cut(_log_odds(earlier[-1]), labels[:, -1] > 0, weight)
        return self

    def predict(self, texts) -> list[np.ndarray]:
        x, out = self.features(texts), []
        for model in self.models:
            out.append(model.predict(*self._with(x, out), len(texts)))
        out[-1] = _sigmoid(_log_odds(out[-1]) - self.shift)
        return out


def _stems(words: Column, letters: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > letters)
    return F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, letters)))


def _drawn(known: DataFrame, categories: list[str], id_col: str, most: int) -> DataFrame:
    """At most ``most`` labels, drawn by a hash of the id within each combination of categories: the rare combinations whole,
    the others in equal numbers. WEIGHT says how many labels of its combination a drawn one stands for."""
    there = {tuple(r[c] for c in categories): r["count"] for r in known.groupBy(*categories).count().collect()}  # combinations of categories
    if sum(there.values()) <= most:
        return known.withColumn(WEIGHT, F.lit(1.0))
    left, parts = most, []
    order = sorted(there, key=lambda k: (there[k], k))
    for i, kind in enumerate(order):
        quota = min(there[kind], left // (len(order) - i))
        left -= quota
        same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(categories, kind, strict=True)])
        part = known.where(same).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(quota)
        parts.append(part.withColumn(WEIGHT, F.lit(there[kind] / max(1, quota))))
    return reduce(DataFrame.unionByName, parts)


def fit_toxicity(texts: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "prompt_id",
                 text_col: str = "prompt", training_texts: int = TRAINING_TEXTS,
                 counted_texts: int = COUNTED_TEXTS) -> ClassifierChain | None:
    """Fits the chain on the texts of at most ``training_texts`` labels, drawn by a hash of the id, rare categories first.

    ``labels`` has ``id_col`` and a 0/1 column per category; rows with a null are left out, of several for an id the maxima
    count, and every text of an id has its labels. The words and stems that tell a category apart are found in the texts of at most
    ``counted_texts`` labels, drawn alike, by counts combined before the shuffle: a word needs more evidence than the luckiest of as many words that tell nothing. None
    without labelled texts.
    """
    known = labels.dropna(subset=[id_col, *categories]).groupBy(id_col).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    given = texts.select(id_col, F.col(text_col).alias("text")).where("text IS NOT NULL")
    labelled = given.join(F.broadcast(_drawn(known, categories, id_col, counted_texts)), id_col)  # bounded by counted_texts
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    stems = [F.array_distinct(_stems(F.col("words"), k)) for k in STEMS]
    listed = labelled.select(words.alias("words"), *categories).select(F.explode(F.concat("words", *stems)).alias("word"), *categories)
    ones = [F.sum(c).alias(c) for c in categories]
    counts = staged(listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *ones).where(F.col("n") >= WORD_TEXTS))  # read once per category
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), *ones).first()
    n = totals["n"]
    if not n:
        return None
    rivals = counts.count()
    vocabulary: dict[str, int] = {}
    for c in categories:
        k = float(totals[c] or 0)
        if not 0 < k < n:
            continue
        a, m = F.col(c).cast("double"), F.col("n").cast("double")
        share, usual = a / m, F.lit(k / n)
        # A bound of the chance that a word of m texts stands in a or more of the category.
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
        evidence = m * (share * F.log(share / usual) + rest)
        telling = (a >= WORD_TEXTS) & (n * a >= WORD_LIFT * m * k)
        chosen = counts.where(telling).select("word", evidence.alias("score")).where(F.col("score") >= math.log(max(rivals, 1) / CHANCE_WORDS))
        for r in chosen.orderBy(F.desc("score"), "word").limit(WORDS).collect():
            vocabulary.setdefault(r["word"], len(vocabulary))
    rows = given.join(F.broadcast(_drawn(known, categories, id_col, training_texts)), id_col)  # bounded by training_texts
    chain = ClassifierChain(vocabulary, categories)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chain.count(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("h"), batch.column(WEIGHT), *[batch.column(c) for c in categories],
                       pa.array([list(f) for f in found], pa.list_(pa.int32())),
                       pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", WEIGHT, *categories, "words", "counts"])

    schema = ", ".join(["h long", f"{WEIGHT} double", *[f"{c} int" for c in categories], "words array<int>", "counts array<int>"])
    flags = [F.col(c).cast("int").alias(c) for c in categories]
    sample = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), WEIGHT, *flags, "text").mapInArrow(
        count, schema).toPandas().sort_values("h")  # bounded by training_texts and WORDS
    fold = np.random.default_rng(7).integers(0, FOLDS, len(sample))
    lengths = sample["words"].map(len).to_numpy()
    x = (np.repeat(np.arange(len(sample)), lengths), np.concatenate([*sample["words"], []]).astype(np.int64),
         1.0 + np.log(np.concatenate([*sample["counts"], []])))
    return chain.fit(x, sample[categories].to_numpy(np.float64), fold, sample[WEIGHT].to_numpy(np.float64))


def judge_toxicity(texts: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "prompt_id",
                   text_col: str = "prompt", training_texts: int = TRAINING_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``p_<category>`` for each category and ``rejected``, the last category being the one that decides.

    Runs on goal prompts (``prompt_id``, ``prompt``) as on any table of texts. Categories are predicted in the given order;
    a later linear model also sees the probabilities of earlier categories, which in training come from models that have
    not seen the text. Features are the words of the whole text, and their first letters, that tell some category apart, with their counts.

    A null text, or one without words, is never rejected; its probabilities are those of a text without known words.
    Without labelled texts all probabilities are null and nothing is rejected. Repeated rows are judged alike; columns
    named like the results are replaced.
    """
    results = [f"p_{c}" for c in categories]
    rows = texts.drop(*results, "rejected")
    chain = fit_toxicity(rows, labels, categories, id_col, text_col, training_texts)
    if chain is None:
        return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in results], F.lit(False).alias("rejected"))
    shared = texts.sparkSession.sparkContext.broadcast(chain)  # at most WORDS words per category

    names = rows.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(text_col).to_pylist()
            found = shared.value.predict(given)
            words = np.array([bool(WORD.search(t or "")) for t in given], dtype=bool)
            columns = [batch.column(c) for c in names] + [pa.array(p) for p in found]
            columns.append(pa.array((found[-1] >= threshold) & words))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *results, "rejected"])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in results],
                           T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(judge, schema)
