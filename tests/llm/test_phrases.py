import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sizewise import datasets
from sizewise.llm import phrases as P
from sizewise.llm.phrases import CountTransducer, frequent, grow, mine_phrases, parted, union


def brute(rows, least=30, top=2000):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for g, t in rows:
        g = "und" if g is None else g
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for p in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", p)
            n[g] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[g][tuple(w[i:i + m])] += 1
    for g, c in f.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i:i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * found[p[i:i + m]]}
        rows = []
        for p in found.keys() - gone:
            score, k = min((2000000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(g, i + 1, p.decode(), -a, left, right, n[g], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def messages(seed, count):
    """Texts of few words, so that many n-grams are frequent; a hot pair, an odd separator here and there, letters of two bytes."""
    rng = random.Random(seed)
    words = ["the", "File", "é", "Éa", "disk\x01", "a-b", "full", " ", "日本", "x" * 40]
    rows = []
    for _ in range(count):
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append("the File" if rng.random() < 0.3 else rng.choice(words))
            text.append(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r"]))
        rows.append((rng.choice(["INFO", "INFO", "INFO", "WARN", None, ""]), "".join(text)))
    return rows


@pytest.mark.parametrize("sizes", [None, (2_000, 300, 1_500)])
def test_against_brute_force(spark, monkeypatch, sizes):
    rows = messages(1, 300) + [("WARN", None), ("WARN", ""), ("INFO", "the file " * 5_000)]
    logs = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "level string, message string, rank int, phrase string").repartition(5)
    range_bytes = P.RANGE_BYTES
    if sizes:  # many small shards, held n-grams and ranges
        monkeypatch.setattr(P, "SHARD_BYTES", sizes[0])
        monkeypatch.setattr(P, "HELD", sizes[1])
        range_bytes = sizes[2]
    for top in (2000, 7):
        assert sorted(tuple(r) for r in mine_phrases(logs, range_bytes=range_bytes, top=top).collect()) == brute(rows, top=top)


def test_empty_table_and_log_rows_of_the_project(spark, sf_dir):
    logs = datasets.logs(spark, sf_dir)
    assert mine_phrases(logs.limit(0)).count() == 0
    rows = [(r.level, r.message) for r in logs.collect()]
    assert sorted(tuple(r) for r in mine_phrases(logs, min_count=5).collect()) == brute(rows, least=5)


def random_trie(rng, words, n, depth):
    ranks = rng.integers(0, len(words), (n, depth))
    reach = rng.integers(1, depth + 1, n)
    return grow(lambda d, rows: ranks[rows, d - 1], reach, pa.array(words, pa.large_binary()), 1)[0]


def listed(trie):
    out, paths = {}, [()]
    words = trie.words.to_pylist()
    for level in trie.levels:
        paths = [(*paths[a], words[w]) for a, w in zip(level.above, level.word)]
        out |= {p: int(n) for p, n in zip(paths, level.count) if n}
    return out


def test_transducers_keep_and_add_counts():
    rng = np.random.default_rng(1)
    a = random_trie(rng, [b"a", b"b", b"c", b"z"], 400, 4)
    b = random_trie(rng, [b"", b"b", b"bb", b"c", b"d"], 300, 3)
    for t in (a, b):
        machine = CountTransducer.unpack(CountTransducer.of(t).pack())
        assert listed(machine.trie()) == listed(t)
    both = listed(union([a, b]))
    assert both == collections.Counter(listed(a)) + collections.Counter(listed(b))
    assert listed(frequent(union([a, b]), 5)) == {p: n for p, n in both.items() if n >= 5}
    # Equal ends are shared: one word after any of many.
    ends = np.array([[k, 0] for k in range(1, 50)])
    comb = grow(lambda d, rows: ends[rows, d - 1], np.full(49, 2), pa.array([b"%02d" % k for k in range(50)], pa.large_binary()), 1)[0]
    assert len(CountTransducer.of(comb).word) == 50
    asked = union([a, b])
    found = CountTransducer.of(a).compose(asked)
    in_a = listed(a)
    for level, counts, paths in zip(asked.levels, found, _paths(asked)):
        assert [in_a.get(p, 0) for p in paths] == list(counts)


def _paths(trie):
    words, paths = trie.words.to_pylist(), [()]
    for level in trie.levels:
        paths = [(*paths[a], words[w]) for a, w in zip(level.above, level.word)]
        yield paths


def test_ranges_part_the_n_grams_by_order():
    rng = np.random.default_rng(3)
    t = random_trie(rng, [b"a", b"b", b"c", b"d"], 500, 4)
    every = listed(t)
    for bounds in ([], [(b"b",)], [(b"a", b"c"), (b"b", b"b", b"bb"), (b"c", b"a", b"a", b"a"), (b"c", b"c"), (b"zz",)], [(b"",), (b"d", b"d", b"d", b"d")]):
        got = {k: listed(part) for k, part in parted(t, bounds)}
        assert collections.Counter() + sum((collections.Counter(p) for p in got.values()), collections.Counter()) == every
        for k, part in got.items():
            assert all(sum(b <= p for b in bounds) == k for p in part)
