"""Pixel operators against plain numpy on small images of awkward sizes."""

import math


import numpy as np
import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise.operators import pixels as pixel_ops
from sizewise.operators import quality, sweep


def table(spark, images):
    """Pixel table of {image id: array of height x width x 4}."""
    rows = []
    for i, a in images.items():
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                rows.append((i, x, y, *[int(v) for v in a[y, x]]))
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")


def image(seed, height, width, flat=False):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (height, width, 4))
    if flat:
        a[:] = (a // 200) * 3
    a[..., 3] = 255
    return a


def flat_runs_by_hand(a):
    d = np.abs(np.diff(a.astype(int), axis=1)).sum(axis=2).reshape(-1)
    runs, current = 0, 0
    for v in d:
        if v < 24:
            current += 1
        else:
            runs += current >= 4
            current = 0
    return runs + (current >= 4), d


@pytest.mark.parametrize("tile", [3, 4, 1024])
def test_neighbours_and_runs(spark, monkeypatch, tile):
    monkeypatch.setattr(pixel_ops, "TILE", tile)
    images = {1: image(1, 5, 9, True), 2: image(2, 7, 4), 3: np.full((6, 5, 4), 9), 4: image(4, 1, 13, True), 5: image(5, 3, 2, True)}
    for seed in range(6, 12):
        images[seed] = image(seed, 6, 7, True)
    got = {r.image_id: r for r in pixel_ops.neighbour_stats(table(spark, images)).collect()}
    for i, a in images.items():
        runs, d = flat_runs_by_hand(a)
        assert got[i].flat_run_count == runs, i
        assert got[i].n_pairs == len(d)
        assert got[i].complexity == pytest.approx(min(d.sum() / len(d) / 1020, 1))
        assert got[i].edge_density == pytest.approx((d > 120).mean())


def ssim_by_hand(l1, l2):
    k = np.exp(-np.add.outer(np.arange(-5, 6) ** 2, np.arange(-5, 6) ** 2) / 4.5)
    k /= k.sum()
    c1, c2, out = 6.5025, 58.5225, []
    for y in range(5, l1.shape[0] - 5):
        for x in range(5, l1.shape[1] - 5):
            w1, w2 = l1[y - 5:y + 6, x - 5:x + 6], l2[y - 5:y + 6, x - 5:x + 6]
            m1, m2 = (k * w1).sum(), (k * w2).sum()
            v1, v2, cov = (k * (w1 - m1) ** 2).sum(), (k * (w2 - m2) ** 2).sum(), (k * (w1 - m1) * (w2 - m2)).sum()
            out.append((2 * m1 * m2 + c1) * (2 * cov + c2) / ((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2)))
    return np.mean(out), len(out)


@pytest.mark.parametrize("tile", [12, 1024])
def test_gaussian_similarity(spark, monkeypatch, tile):
    monkeypatch.setattr(quality, "TILE", tile)
    a, b = {1: image(1, 14, 27)}, {1: image(2, 14, 27)}
    pairs = quality.pair_pixels(table(spark, a), table(spark, b))
    row = quality.ssim_gauss(pairs).first()
    luma = np.array([0.299, 0.587, 0.114])
    value, n = ssim_by_hand(a[1][..., :3] @ luma, b[1][..., :3] @ luma)
    assert row.n_windows == n
    assert row.ssim == pytest.approx(value, abs=1e-12)


def test_small_images_use_all_pixels(spark):
    a, b = {1: image(1, 4, 6)}, {1: image(2, 4, 6)}
    pairs = quality.pair_pixels(table(spark, a), table(spark, b))
    assert quality.ssim_gauss(pairs).count() == 0
    luma = np.array([0.299, 0.587, 0.114])
    l1, l2 = (a[1][..., :3] @ luma).ravel(), (b[1][..., :3] @ luma).ravel()
    m1, m2, cov = l1.mean(), l2.mean(), ((l1 - l1.mean()) * (l2 - l2.mean())).mean()
    expected = (2 * m1 * m2 + 6.5025) * (2 * cov + 58.5225) / ((m1**2 + m2**2 + 6.5025) * (l1.var() + l2.var() + 58.5225))
    assert quality.ssim(pairs).first().ssim == pytest.approx(expected)


def test_identical_pixels_are_lossless(spark):
    t = table(spark, {1: image(1, 12, 12)})
    row = quality.mse_psnr(quality.pair_pixels(t, t)).first()
    assert row.mse == 0 and math.isinf(row.psnr)


def test_invisible_colours_do_not_count(spark):
    a, b = image(1, 3, 3), image(2, 3, 3)
    a[..., 3] = b[..., 3] = 0
    row = quality.mse_psnr(quality.pair_pixels(table(spark, {1: a}), table(spark, {1: b}))).first()
    assert row.mse == 0


def test_overlap_only(spark):
    a, b = {1: image(1, 5, 5)}, {1: image(1, 5, 5)[:3, :4]}
    assert quality.pair_pixels(table(spark, a), table(spark, b)).count() == 12


@pytest.mark.parametrize("width, height", [(300, 40), (40, 300), (10, 10), (257, 1)])
def test_preview_picks_each_target_once(spark, width, height):
    rows = spark.range(width * height).select(
        F.lit(1).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"),
        F.floor(F.col("id") / width).cast("int").alias("y"), *[F.lit(1).alias(c) for c in "rgba"],
    )
    sizes = spark.createDataFrame([(1, width, height)], "image_id long, width int, height int")
    scale = min(1, 256 / max(width, height))
    tw, th = max(math.floor(width * scale + 0.5), 1), max(math.floor(height * scale + 0.5), 1)
    got = pixel_ops.preview(rows, sizes).select("x", "y").collect()
    assert sorted((r.x, r.y) for r in got) == [(x, y) for x in range(tw) for y in range(th)]


def test_entropy_of_known_counts(spark):
    a = np.zeros((2, 2, 4), int)
    a[0, 0, 0], a[0, 1, 0] = 100, 200
    row = sweep.rung_entropy(table(spark, {1: a}), [100]).first()
    assert row.bits == pytest.approx(2 * 0.25 * 4 * 2 + 0.5 * 4)


def test_gaussian_similarity_on_all_images(spark, sf_dir):
    """The separable windows against the direct kernel on every image of the tables."""
    pixels = D.pixels(spark, sf_dir)
    copy = pixels.select("image_id", "x", "y", *[sweep.quantized(c, F.lit(16)).alias(c) for c in "rgb"], "a")
    pairs = quality.pair_pixels(pixels, copy)
    got = {r.image_id: r.ssim for r in quality.ssim_gauss(pairs).collect()}
    grids = {}
    for r in pairs.select("image_id", "x", "y", "l1", "l2").collect():
        g = grids.setdefault(r.image_id, (np.zeros((16, 16)), np.zeros((16, 16))))
        g[0][r.y, r.x], g[1][r.y, r.x] = r.l1, r.l2
    assert set(got) == set(grids)
    for i, (l1, l2) in grids.items():
        assert got[i] == pytest.approx(ssim_by_hand(l1, l2)[0], abs=1e-9)


def test_errors_and_entropy_of_all_rungs_come_from_one_histogram(spark, sf_dir):
    from sizewise.operators import quality as Q
    from sizewise.operators import sweep as S

    pixels = D.pixels(spark, sf_dir)
    ladder = [100, 85, 40, 3]
    pairs = Q.mse_psnr(S.quantized_pairs(pixels, ladder), ["image_id", "q"])
    direct = {(r.image_id, r.q): r.mse for r in pairs.collect()}
    histogram = S.expand_histogram(S.channel_histogram(pixels), ladder)
    got = {(r.image_id, r.q): r.mse for r in S.mse_of_histogram(histogram).collect()}
    assert got == direct
    # The pixels are shuffled once, as counts; what follows are sums of counts.
    plan = S.mse_of_histogram(histogram)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_count" in plan and plan.count("FileScan") == 1
    assert S.rung_entropy(pixels.limit(0), ladder).count() == 0
