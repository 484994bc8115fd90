import numpy as np
import pytest

from sizewise.llm.embeddings import link_counts, near_duplicate_vectors, window_links


def brute(rows, least=0.9):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    kept = {i: np.array(v, float) for i, v in rows if i is not None and good(v)}
    ids = sorted(kept)
    linked = {i: {i} for i in ids}
    for a in ids:
        for b in ids:
            u, v = kept[a], kept[b]
            if a != b and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                linked[a].add(b)
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in linked[i]) for i in ids}
        if new == label:
            break
        label = new
    return {i: (len(linked[i]) - 1, label[i]) if i in linked else (0, i) for i, _ in rows}


def vectors(seed, clusters, members, spread, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(members):
            out.append((centre + rng.standard_normal(dim) * spread / np.sqrt(dim)) * rng.uniform(0.5, 2))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]


@pytest.mark.parametrize("spread", [0.15, 0.3])
def test_against_all_pairs(spark, spread):
    rows = vectors(1, 12, 14, spread)
    rows += [(900 + i, rows[3][1]) for i in range(20)]  # copies
    rows += [(950, None), (951, []), (952, [0.0] * 24), (953, [float("nan")] * 24), (954, [None] + [1.0] * 23), (955, [float("inf")] * 24),
             (956, [1.0, 2.0]), (957, [2.0, 4.0]), (958, [x * 1e30 for x in rows[0][1]])]
    images = spark.createDataFrame(rows, "image_id long, embedding array<double>")
    got = near_duplicate_vectors(images).collect()
    expected = brute(rows)
    assert {r.image_id: (r.n_links, r.component_id) for r in got} == expected
    assert all(r.kept == (r.image_id == r.component_id) for r in got)


def test_links_of_a_component_are_counted_exactly(spark):
    rows = vectors(5, 1, 60, 0.5)
    classes = spark.createDataFrame([(i, 1 + i % 3, v) for i, v in rows], "rep long, copies long, vec array<double>")
    part = spark.createDataFrame([(i, 0) for i, _ in rows], "id long, component long")
    got = {r.id: r.links for r in link_counts(classes, part, block=7).collect()}
    for i, v in rows:
        u = np.array(v)
        assert got[i] == sum(1 + j % 3 for j, w in rows if u @ np.array(w) / np.sqrt((u @ u) * (np.array(w) @ np.array(w))) >= 0.9)


def test_null_ids_repeats_clashes_and_empty_table(spark):
    rows = [(4, [1.0, 0.0], "a"), (4, [1.0, 0.0], "a"), (6, [1.0, 0.001], "b"), (None, [1.0, 0.0], "c")]
    images = spark.createDataFrame(rows, "image_id long, embedding array<float>, rep string")
    got = near_duplicate_vectors(images).collect()
    assert sorted(((r.image_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(4, 1, 4, True), (4, 1, 4, True), (6, 1, 4, False), (None, 0, None, True)], key=repr)
    assert near_duplicate_vectors(images.limit(0)).count() == 0


def test_passes_follow_the_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    shared = np.ones(32) / np.sqrt(32)  # a mean cosine of 0.5, so that few orders part the vectors
    base = np.sqrt(0.5) * shared + np.sqrt(0.5) * rng.standard_normal((4000, 32)) / np.sqrt(32)
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((200, 32))
    away -= (away * base[:200]).sum(1)[:, None] * base[:200]
    away /= np.linalg.norm(away, axis=1)[:, None]
    pairs = 0.905 * base[:200] + np.sqrt(1 - 0.905**2) * away
    rows = [(i, 32, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, pairs]))]
    vectors = spark.createDataFrame(rows, "rep long, dim int, vec array<double>")
    links = {(r.a, r.b) for r in window_links(vectors, passes=3, window=8).collect()}
    assert all(0 <= a < b < len(rows) for a, b in links)
    assert sum((i, 4000 + i) in links for i in range(200)) >= 190


def test_links_do_not_depend_on_partitions(spark):
    """Isolated pairs at the threshold; with many partitions most hold fewer rows than the window, and some none."""
    rng = np.random.default_rng(13)
    base = rng.standard_normal((500, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal(base.shape)
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    rows = [(i, 24, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, 0.905 * base + np.sqrt(1 - 0.905**2) * away]))]
    vectors = spark.createDataFrame(rows, "rep long, dim int, vec array<double>")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({(r.a, r.b) for r in window_links(vectors, passes=3, recall=0.0).collect()})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and len(found[0]) > 200
