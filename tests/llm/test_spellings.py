import collections
import random
import re
import zlib

import pytest

from sizewise import datasets
from sizewise.llm.spellings import TrieNumbers, group_spellings


def brute(rows):
    counts, near, groups, form = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list), {}
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += len(w) >= 5
    counts = {w: n for w, n in counts.items() if n >= 3}
    for w in counts:
        for k in range(len(w)):
            groups[w[:k], w[k + 1:]].append(w)
            if (v := w[:k] + w[k + 1:]) in counts:
                near[w].add(v)
                near[v].add(w)
    for g in groups.values():
        for w in g:
            near[w] |= set(g) - {w}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def prompts(seed, n):
    """Words of few letters with slips: doubled letters, chains of forms, long equal beginnings and ends."""
    rng = random.Random(seed)
    bases = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(60)] + ["compress" + s for s in ("ed", "or", "ion", "ions", "es")]
    bases += ["q" * 70 + s for s in ("a", "b", "ab", "aab")] + ["Été" * 3, "ééééé", "÷×÷×÷"]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(bases[:1 + int(len(bases) * rng.random() ** 2)])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]])
            text.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i if rng.random() < 0.97 else None, rng.choice([" ", "-", "ß1", "\n", "Ā"]).join(text)))
    return rows


@pytest.mark.parametrize("range_words", [50_000, 40])
def test_against_brute_force(spark, range_words):
    rows = prompts(1, 900) + [(5000, None), (5001, ""), (5002, "x" * 1_000 + " " + "x" * 999), (5003, "12 _ ĀĀĀĀĀ"), (7, "abéabé " * 3_000)]
    rows += [(6000 + k, "x" * 1_000 + " " + "x" * 999) for k in range(4)] + [rows[0]] * 3
    requests = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "request_id long, prompt string, word string, n int").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in group_spellings(requests, range_words=range_words).collect()}
    assert got == brute(rows)


def test_a_very_long_run_of_letters(spark):
    rows = [(i, "x" * 100_000 + " " + "x" * 50_000 + "y" + "x" * 50_000) for i in range(6)] + [(9, "y" * 100_000)]
    got = {r.word[:1] + r.word[50_000:50_002] + str(len(r.word)): (len(r.form or ""), r.n, r.n_near)
           for r in group_spellings(spark.createDataFrame(rows, "request_id long, prompt string")).collect()}
    assert got == {"xxx100000": (0, 6, 1), "xyx100001": (0, 6, 1)}


def test_empty_table_and_prompts_of_the_project(spark, sf_dir):
    requests = datasets.goal_requests(spark, sf_dir)
    assert group_spellings(requests.limit(0)).count() == 0
    rows = [(r.request_id, r.prompt) for r in requests.collect()]
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in group_spellings(requests).collect()} == brute(rows)


def test_nodes_are_numbered_alike_across_ranges():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(400)})
    for bounds in ([], ["b"], ["aab", "ab", "abéa", "b", "é"]):
        numbers = TrieNumbers(bounds)
        node_of = {}
        for k in range(len(bounds) + 1):
            here = [w for w in words if numbers.range_of(w) == k]
            if here:
                nodes, ends = numbers.number(here, k)
                for w, a, b in zip(here, ends, ends[1:]):
                    assert b - a == len(w) + 1
                    for depth, node in enumerate(nodes[a:b]):
                        assert node_of.setdefault(w[:depth], node) == node
        assert len(set(node_of.values())) == len(node_of)
