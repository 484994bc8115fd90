import re

import pytest

from sizewise.llm.decontaminate import contamination, item_windows, without_contaminated


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"before {PASSAGE} after"), (2, PASSAGE.upper().replace(" ", ", ")), (3, None), (4, ""), (5, "short item here"),
    (6, "one two three four five six seven eight nine"), (7, "é short\nITEM; here " * 3), (8, "... --- ..."),
    (9, f"{PASSAGE} {PASSAGE}"), (None, PASSAGE), (10, "x " * 3000 + PASSAGE),
]
ITEMS = [("a", PASSAGE), ("b", "Short item here"), ("c", None), ("d", "--"), ("b", "Short item here"), ("e", PASSAGE), (None, "here é")]


@pytest.mark.parametrize("slices", [500_000, 2])
def test_against_brute_force(spark, slices):
    docs = spark.createDataFrame(DOCS, "log_id long, message string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contamination(docs, items, broadcast_windows=slices).collect()
    assert sorted(((r.log_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == brute(DOCS, ITEMS)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in got)


def test_rows_that_repeat_and_clashing_columns(spark):
    rows = [(1, PASSAGE, "k", 1), (1, PASSAGE, "k", 1), (1, "clean text", "k", 2), (2, "clean", "k", 3)]
    docs = spark.createDataFrame(rows, "log_id long, message string, window string, n int")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert contamination(docs, items).count() == 3
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.n for r in left.collect()) == [2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "log_id long, message string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert contamination(docs, items).where("n_hit > 0").count() == 0
    assert contamination(docs.limit(0), spark.createDataFrame(ITEMS, items.schema)).count() == 0


def test_windows_of_an_item(spark):
    got = item_windows(spark.createDataFrame(ITEMS, "item_id string, text string"), "item_id", "text").collect()
    assert sorted((r.length, r["items"]) for r in got) == [(2, []), (3, ["b"]), (10, ["a", "e"]), (10, ["a", "e"]), (10, ["a", "e"])]
