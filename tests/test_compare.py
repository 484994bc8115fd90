"""Tiles against the pixel tables that hold a row per pixel and step."""

import math
import random

from pyspark.sql import functions as F

from sizewise.operators import compare
from sizewise.operators.quality import perceptual_damage, ssim_block
from sizewise.operators.sweep import channel_histogram, mse_of_histogram
from sizewise.plans.library import distortions
from sizewise.session import cut_lineage

SCHEMA = "image_id long, x int, y int, r int, g int, b int, a int"


def rows_of(i, width, height, seed, noise):
    rng = random.Random(seed)
    v = lambda: max(0, min(255, int(rng.gauss(120, noise))))
    return [(i, x, y, v(), v(), v(), rng.choice([255, 255, 128, 0])) for y in range(height) for x in range(width)]


def by_rows(pixels, wanted):
    """The measures by rows of pixels, each by itself."""
    errors = mse_of_histogram(channel_histogram(pixels).join(wanted.distinct().withColumn("q", F.col("step")), "image_id")).collect()
    pairs = cut_lineage(distortions(pixels, wanted))
    similar = {(r.image_id, r.q): r.ssim for r in ssim_block(pairs, ["image_id", "q"]).collect()}
    damage = {(r.image_id, r.q): r.damage for r in perceptual_damage(pairs, ["image_id", "q"]).collect()}
    return {k: (r.mse, r.psnr, similar.get(k), damage[k]) for r in errors for k in [(r.image_id, r.q)]}


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_tiles_measure_what_pixel_rows_do(spark, monkeypatch):
    monkeypatch.setattr(compare, "TILE", 32)  # several tiles in both directions
    monkeypatch.setattr(compare, "PIECE", 3_000)
    rows = rows_of(1, 64, 64, 1, 60) + rows_of(2, 45, 37, 2, 20) + rows_of(3, 5, 3, 3, 90) + rows_of(4, 70, 8, 4, 5) + rows_of(5, 8, 8, 5, 0)
    rows += rows_of(6, 16, 16, 6, 40)[:100] * 2 + rows_of(7, 16, 24, 7, 40)[::3]  # rows given twice, and gaps
    odd = rows_of(8, 24, 20, 8, 50)
    rows += [(*r[:3 + k % 4], None, *r[4 + k % 4:]) if k % 7 == 0 else r for k, r in enumerate(odd)]
    rows += [(8, None, 3, 9, 9, 9, 255), (8, 4, None, 7, 80, 9, 255), (8, None, None, 1, 2, 3, 200), (9, 0, 0, None, None, None, None), (None, 1, 1, 1, 1, 1, 1)]
    pixels = cut_lineage(spark.createDataFrame(rows, SCHEMA).repartition(5))
    wanted = [(i, s) for i in range(1, 11) for s in ((1, 2, 9) if i % 2 else (3, 20, 9)) for _ in range(2)]
    wanted = spark.createDataFrame(wanted, "image_id long, step int")
    expected = by_rows(pixels, wanted)
    found = compare.compare_steps(compare.pixel_tiles(pixels), wanted).collect()
    got = {(r.image_id, r.step): (r.mse, r.psnr, r.ssim, r.damage) for r in found}
    assert len(got) == len(found) == 27 and got.keys() == expected.keys()
    for key, values in expected.items():
        assert all(map(same, got[key], values)), (key, got[key], values)
    assert compare.compare_steps(compare.pixel_tiles(pixels.limit(0)), wanted).count() == 0


def test_no_row_is_made_per_pixel_and_step(spark):
    tiles = compare.pixel_tiles(spark.createDataFrame(rows_of(1, 64, 64, 1, 60), SCHEMA))
    assert tiles.count() == 2
    wanted = spark.createDataFrame([(1, s) for s in range(1, 20)], "image_id long, step int")
    plan = compare.compare_steps(tiles, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
