import random

import numpy as np
from pyspark.sql import functions as F

from sizewise.llm.toxicity import ClassifierChain, LinearModel, fit_toxicity, judge_toxicity

BAD = ["grumbo", "snarfle", "blecht"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic, junk = int(rng.random() < 0.2), int(rng.random() < 0.2)
        text = [f"word{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        text += rng.choices(BAD, k=rng.randint(1, 3)) if toxic else []
        text += ["spam"] * rng.randint(2, 6) if junk else []
        rng.shuffle(text)
        rows.append((i, " ".join(text).replace("word3", "Word3"), junk, toxic))
    return rows


def test_held_out_accuracy_and_special_texts(spark):
    rows = corpus(1500, 1)
    texts = spark.createDataFrame([(i, t, 9) for i, t, _, _ in rows], "prompt_id long, prompt string, rejected int")
    labels = spark.createDataFrame([(i, j, x) for i, _, j, x in rows[:700]] + [(None, 0, 1), (5, None, 1)], "prompt_id long, junk int, toxic int")
    got = {r.prompt_id: r for r in judge_toxicity(texts, labels, ["junk", "toxic"]).collect()}
    for i, _, junk, toxic in rows[700:]:
        assert got[i].rejected == bool(toxic), i
        assert (got[i].p_junk > 0.5) == bool(junk)
    special = spark.createDataFrame([(1, None), (2, ""), (3, "42 !"), (None, "what a GRUMBO! snarfle"), (4, "clean " * 50_000 + "blecht, grumbo")],
                                    "prompt_id long, prompt string")
    both = texts.select("prompt_id", "prompt").unionByName(special)
    got = judge_toxicity(both, labels, ["junk", "toxic"])
    assert got.columns == ["prompt_id", "prompt", "p_junk", "p_toxic", "rejected"]
    found = {(r.prompt_id, (r.prompt or "")[:8]): r.rejected for r in got.collect()}
    assert not found[1, ""] and not found[2, ""] and not found[3, "42 !"]
    assert found[None, "what a G"]


def test_no_labels_and_empty_table(spark):
    texts = spark.createDataFrame([(1, "some text")], "prompt_id long, prompt string")
    none = spark.createDataFrame([], "prompt_id long, junk int, toxic int")
    row = judge_toxicity(texts, none, ["junk", "toxic"]).first()
    assert row.p_toxic is None and row.rejected is False
    assert judge_toxicity(texts.limit(0), none, ["toxic"]).count() == 0


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(3)
    n = 400
    first = rng.integers(0, 2, n)
    rows, cols = np.flatnonzero(first), np.zeros(first.sum(), np.int64)
    x = (rows, cols, np.ones(len(rows)))
    chain = ClassifierChain({"w": 0}, ["a", "b"]).fit(x, np.stack([first, first], axis=1), rng.integers(0, 5, n))
    assert len(chain.models[1].weights) == 2 and chain.models[1].weights[1] > 0
    model = LinearModel(1).fit(*x, first)
    assert ((model.predict(*x, n) > 0.5) == first).all()


def test_few_positives_are_told_apart(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        toxic = int(i % 60 == 0 or i >= 540)  # of the labelled first 300 five are toxic
        text = [f"word{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(text + (BAD if toxic else [])), 0, toxic))
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "prompt_id long, prompt string")
    labels = spark.createDataFrame([(i, j, x) for i, _, j, x in rows[:300]], "prompt_id long, junk int, toxic int")
    got = {r.prompt_id: r.rejected for r in judge_toxicity(texts, labels, ["junk", "toxic"]).collect()}
    held_out = [(got[i], bool(x)) for i, _, _, x in rows[300:]]
    assert sum(g for g, x in held_out if x) >= 0.9 * sum(x for _, x in held_out)
    assert not any(g for g, x in held_out if not x)


def test_a_bounded_sample_keeps_rare_labels(spark):
    rows = [(i, f"common{chr(97 + i % 26)} text" + (" grumbo snarfle" if i % 200 == 0 else ""), 0, int(i % 200 == 0)) for i in range(2000)]
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "prompt_id long, prompt string")
    labels = spark.createDataFrame([(i, j, x) for i, _, j, x in rows], "prompt_id long, junk int, toxic int")
    chain = fit_toxicity(texts, labels, ["junk", "toxic"], training_texts=100)
    assert {"grumbo", "snarfle"} <= set(chain.vocabulary)
    assert chain.predict(["what a grumbo snarfle"])[-1][0] >= 0.5 > chain.predict(["common text"])[-1][0]


def test_held_out_labels_of_the_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    chain_labels = labels.where(~held_out).select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    judged = judge_toxicity(docs, chain_labels, ["junk", "toxic"], "doc_id", "text").select("doc_id", "rejected")
    found = judged.join(labels.where(held_out), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()
    rate = {(r.quality, r.toxic): r.r for r in found}
    # Labels of documents of low quality are noisy: half of the toxic ones hold no insult that any other document holds.
    assert rate[1, 1] >= 0.9 and rate[1, 0] <= 0.03 and rate[0, 0] <= 0.03 and rate[0, 1] >= 0.4


def test_rare_words_do_not_pass_for_insults(spark):
    """Insults in a few per cent of texts, several of them inflected, among many words that are as rare."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        toxic = int(i % 31 == 0)
        text = [f"w{chr(97 + rng.randint(0, 25))}{rng.randint(0, 3000):x}" for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(text + ([rng.choice(BAD) + rng.choice(["", "en", "ou", "que"])] * rng.randint(1, 2) if toxic else [])), 0, toxic))
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "prompt_id long, prompt string")
    labels = spark.createDataFrame([(i, j, x) for i, _, j, x in rows if i % 3], "prompt_id long, junk int, toxic int")
    got = {r.prompt_id: r.rejected for r in judge_toxicity(texts, labels, ["junk", "toxic"]).collect()}
    held_out = [(got[i], x) for i, _, _, x in rows if i % 3 == 0]
    assert sum(g for g, x in held_out if x) >= 0.9 * sum(x for _, x in held_out)
    assert sum(g for g, x in held_out if not x) <= 0.01 * len(held_out)
    assert len(fit_toxicity(texts, labels, ["junk", "toxic"]).vocabulary) <= 40
