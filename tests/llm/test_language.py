import math

import numpy as np

from sizewise.llm.language import ORDER, ContextTree, detect_language, grams_of


def brute_bits(training: bytes, text: bytes) -> float:
    """Prediction by partial matching with plain dictionaries."""
    counts = {}
    padded = b"\n" * ORDER + training
    for i in range(ORDER, len(padded)):
        for k in range(ORDER + 1):
            counts.setdefault(padded[i - k:i], {}).setdefault(padded[i], 0)
            counts[padded[i - k:i]][padded[i]] += 1
    total, padded = 0.0, b"\n" * ORDER + text
    for i in range(ORDER, len(padded)):
        for k in range(ORDER, -1, -1):
            seen = counts.get(padded[i - k:i])
            if seen is None:
                continue
            n, t = sum(seen.values()), len(seen)
            if padded[i] in seen:
                total += math.log2((n + t) / seen[padded[i]])
                break
            total += math.log2((n + t) / t)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    training = "abracadabra, the cat and the hat. é".encode()
    texts = [b"abra", "the hut é ü".encode(), b"", b"zzz\x00", training]
    grams, starts, ends = grams_of(np.frombuffer(training, np.uint8), np.array([0, len(training)]))
    keys, n = np.unique(grams[starts[0]:ends[0]], return_counts=True)
    tree = ContextTree(keys, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams, starts, ends = grams_of(data, np.cumsum([0, *map(len, texts)]))
    for text, a, b in zip(texts, starts, ends, strict=True):
        assert abs(tree.bits(grams[a:b]).sum() - brute_bits(training, text)) < 1e-9


LANGS = {"en": "the quick brown fox jumps over the lazy dog and then some more of that ", "de": "der schnelle braune Fuchs springt über den faulen Hund und noch mehr davon ",
         "fr": "le rapide renard brun saute par-dessus le chien paresseux et encore un peu "}


def test_held_out_texts_and_special_ones(spark):
    training = spark.createDataFrame(
        [(i, t[i % 20:] + t, k) for k, t in LANGS.items() for i in range(30)] + [(99, None, "en"), (98, "x y z", None)],
        "prompt_id long, prompt string, lang string")
    rows = [(1, "over the brown dog", "en", 5), (2, "über den Hund", "de", 5), (3, "le chien brun", "fr", 5), (4, None, "und", 5), (5, "", "und", 5),
            (6, "123 ... !", "und", 5), (7, "the fox " * 40_000, "en", 5), (None, "the lazy dog", "en", 5), (1, "over the brown dog", "en", 5)]
    texts = spark.createDataFrame(rows, "prompt_id long, prompt string, expected string, score int")
    got = detect_language(texts, training).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == r.expected and 0 <= r.score <= 1
        assert (r.score == 0) == (r.expected == "und")
    assert detect_language(texts.limit(0), training).count() == 0
    assert {r.lang_pred for r in detect_language(texts, training.limit(0)).collect()} == {"und"}


def test_accuracy_on_held_out_documents(spark, sf_dir):
    from sizewise.llm.queries import op2_language

    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = op2_language(spark, sf_dir).join(langs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
