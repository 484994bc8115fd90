import random
import re

import numpy as np
import pytest

from sizewise.llm.common import connected_components
from sizewise.llm.minhash import mixed, near_duplicates, shingle_sets, super_minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = root(x), root(y)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups, copies, length):
    """Copies of each base text with a few words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(rng.randint(1, copies)):
            own = base[:]
            for _ in range(rng.randint(0, max(1, length // 40))):
                own[rng.randrange(length)] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(own)))
    return rows


@pytest.mark.parametrize("block", [128, 6])
def test_against_brute_force(spark, block):
    rows = corpus(1, 30, 8, 60) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(2, 1, 90, 80))]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "two words"), (5004, "TWO\twords"), (5005, "words two"),
             (5006, "long " * 30_000), (5007, "é è"), (5008, "É è")]
    got = near_duplicates(spark.createDataFrame(rows, "log_id long, message string"), block=block).collect()
    expected = brute(rows)
    assert {r.log_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.log_id == r.component_id) for r in got)


def test_null_ids_repeats_clashes_and_empty_table(spark):
    rows = [(3, "a b c d e f g", 1), (3, "a b c d e f g", 1), (7, "A b c d e f g", 2), (None, "a b c d e f g", 3), (7, "other text here", 4)]
    docs = spark.createDataFrame(rows, "log_id long, message string, rep int")
    got = near_duplicates(docs).collect()
    assert sorted(((r.log_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(3, 3, True), (3, 3, True), (7, 3, False), (7, 7, True), (None, None, True)], key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity_and_step_order_does_not_matter():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        both = mixed(rng.integers(0, 2**63, int(900 * share), dtype=np.uint64))
        a, b = (np.concatenate([both, mixed(rng.integers(0, 2**63, 900 - len(both), dtype=np.uint64))]) for _ in range(2))
        jaccard = len(both) / (2 * 900 - len(both))
        s = super_minhash(np.concatenate([a, b]), np.array([900, 900]))
        assert abs((s[0] == s[1]).mean() - jaccard) < 0.12
        assert (super_minhash(a[::-1].copy(), np.array([900]))[0] == s[0]).all()


def test_each_set_fills_all_slots():
    s = super_minhash(np.array([5, 6, 7], dtype=np.uint64), np.array([1, 0, 2]))
    assert (s[[0, 2]] < 2**63).all() and (s[1] == np.iinfo(np.uint64).max).all()
    assert sorted(s[0] >> np.uint64(56)) == list(range(128))


def test_sets_of_shingles():
    texts = ["a b c d e f", "a b  c\nd e", "", "A B C D E", "x", "a b c d e a b c d e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    elements, sizes = shingle_sets(data, np.cumsum([0, *map(len, texts)]))
    assert list(sizes) == [len(shingles(t)) for t in texts]
    ends = np.cumsum([0, *sizes])
    assert set(elements[ends[1]:ends[2]]) == set(elements[ends[3]:ends[4]]) < set(elements[ends[0]:ends[1]])


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    loose = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    links = chain + star + loose + [(None, 5), (7, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    """Files of ids are far smaller than their rows, so the planner would send them all through the driver."""
    from sizewise.llm import common, minhash

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common_staged(df)

    common_staged = common.staged
    monkeypatch.setattr(common, "staged", noted)
    monkeypatch.setattr(minhash, "staged", noted)
    rows = corpus(3, 12, 8, 60) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(4, 1, 40, 80))]
    found = near_duplicates(spark.createDataFrame(rows, "log_id long, message string"), block=6)
    noted(found)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 8 and not [p for p in joins if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
