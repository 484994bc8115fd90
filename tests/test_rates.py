"""Sizes by format against plain loops over small images."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sizewise.operators import rates


def picture(seed, width, height):
    rng = random.Random(seed)
    flat = [rng.randint(0, 255) for _ in range(4)]
    return {(x, y): tuple(max(0, min(255, flat[k] + (x * 3 if seed % 2 else 0) + rng.randint(-seed, seed))) for k in range(4))
            for y in range(height) for x in range(width)}


def table(spark, images):
    rows = [(i, x, y, *c) for i, p in images.items() for (x, y), c in p.items()]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")


def entropy(counter):
    n = sum(counter.values())
    return n * math.log2(n) - sum(k * math.log2(k) for k in counter.values()) + (len(counter) - 1) / 2 * math.log2(n)


def coefficients(cells):
    basis = rates.basis()
    z = [[sum(basis[v][j] * sum(basis[u][i] * cells.get((i, j), 0) for i in range(8)) for j in range(8)) for u in range(8)] for v in range(8)]
    order = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)]
    assert rates.zigzag()[:10] == order  # row, column
    return [z[v][u] for v, u in rates.zigzag()]


def lossy(p, fmt, step):
    def level(c):
        unit = step << 20
        k = (abs(c) + unit // 2) // unit
        return -k if c < 0 else k

    counts = {}
    for comp in range(3):
        blocks = {}
        for (x, y), (r, g, b, _) in p.items():
            v = [(77 * r + 150 * g + 29 * b + 128) // 256 - 128, (-43 * r - 85 * g + 128 * b + 128) // 256, (128 * r - 107 * g - 21 * b + 128) // 256][comp]
            blocks.setdefault((y // 8, x // 8), {})[x % 8, y % 8] = v
        z = {k: coefficients(c) for k, c in blocks.items()}
        for (by, bx), c in z.items():
            lv = [level(e) for e in c]
            put = lambda context, symbol: counts.setdefault((comp > 0, context), Counter()).update([symbol])  # noqa: E731, B023
            put("first", lv[0] - (level(z[by, bx - 1][0]) if bx else 0))
            used = [i for i in range(1, 64) if lv[i]]
            if fmt == "JPEG":
                for k, i in enumerate(used):
                    put("run", (i - (used[k - 1] if k else 0) - 1, lv[i]))
                put("run", "end")
                continue
            last = used[-1] if used else 0
            put("last", last)
            for i in range(1, last + 1):
                band = sum(i > e for e in (2, 5, 9, 20))
                put((band, fmt == "AVIF" and i > 1 and lv[i - 1] != 0), lv[i])
    return sum(entropy(c) for c in counts.values())


def test_lossy_bits_against_loops(spark):
    images = {1: picture(40, 16, 16), 2: picture(3, 19, 11), 3: {(0, 0): (7, 7, 7, 255)}, 4: picture(0, 8, 8)}
    wanted = [(i, f, s) for i in images for f in ("JPEG", "WEBP", "AVIF", "PNG") for s in (1, 5, 20)]
    wanted = spark.createDataFrame(wanted, "image_id long, format string, step int")
    got = {(r.image_id, r.format, r.step): r.bits for r in rates.lossy_bits(rates.block_coefficients(table(spark, images)), wanted).collect()}
    assert set(got) == {(i, f, s) for i in images for f in ("JPEG", "WEBP", "AVIF") for s in (1, 5, 20)}
    for (i, f, s), bits in got.items():
        assert abs(bits - max(0, lossy(images[i], f, s))) < 1e-6, (i, f, s)
    assert len({got[1, f, 5] for f in ("JPEG", "WEBP", "AVIF")}) == 3  # formats differ


def filtered(p, width, height):
    out = {f: [Counter() for _ in range(4)] for f in range(6)}
    for y in range(height):
        lines = []
        for f in range(5):
            residuals = []
            for x in range(width):
                for k in range(4):
                    left, above, corner = (p[q][k] if q in p else 0 for q in ((x - 1, y), (x, y - 1), (x - 1, y - 1)))
                    guess = left + above - corner
                    nearest = min((left, above, corner), key=lambda c: abs(guess - c))  # noqa: B023
                    residuals.append((k, (p[x, y][k] - [0, left, above, (left + above) // 2, nearest][f]) % 256))
            lines.append(residuals)
            for k, r in residuals:
                out[f][k][r] += 1
        best = min(range(5), key=lambda f: (sum(min(r, 256 - r) for _, r in lines[f]), f))  # noqa: B023
        for k, r in lines[best]:
            out[5][k][r] += 1
    return {f: sum(entropy(c) for c in cs) + (3 * height if f == 5 else 0) for f, cs in out.items()}


def test_scanline_filters_against_loops(spark, monkeypatch):
    monkeypatch.setattr(rates, "TILE", 4)  # lines over several tiles
    images = {1: (picture(40, 16, 16), 16, 16), 2: (picture(3, 9, 5), 9, 5), 3: (picture(0, 1, 1), 1, 1), 4: (picture(1, 1, 7), 1, 7)}
    pixels = table(spark, {i: p for i, (p, _, _) in images.items()})
    got = {(r.image_id, r.filter): r.bits for r in rates.scanline_sweep(pixels).collect()}
    for i, (p, w, h) in images.items():
        for f, bits in filtered(p, w, h).items():
            assert abs(got[i, f] - max(0, bits)) < 1e-6, (i, f)
    best = {(r.image_id, r.format): (r.bits, r.filter) for r in rates.lossless_bits(pixels).collect()}
    assert all(best[i, "PNG"] == min((got[i, f], f) for f in range(6)) for i in images)
    assert {f for _, f in best} == {"PNG", "WEBP"}
    assert rates.scanline_sweep(pixels.limit(0)).count() == 0


def test_blocks_take_one_shuffle_of_the_pixels(spark):
    blocks = rates.block_coefficients(table(spark, {1: picture(5, 8, 8)})).drop("left")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # both aggregates


def test_damage_is_zero_for_equal_pictures_and_grows(spark):
    from sizewise.operators.quality import perceptual_damage
    from sizewise.operators.sweep import quantized_pairs

    pairs = quantized_pairs(table(spark, {1: picture(40, 24, 24)}), [100, 80, 50, 20])
    got = {r.q: r.damage for r in perceptual_damage(pairs, ["image_id", "q"]).collect()}
    assert got[100] == 0 and got[100] < got[80] < got[50] < got[20]
    assert perceptual_damage(pairs.where(F.lit(False)), ["image_id", "q"]).count() == 0


def test_pixels_are_never_broadcast(spark):
    from sizewise.operators import pixels as X
    from sizewise.operators import quality
    from sizewise.plans.library import distortions

    pixels = table(spark, {1: picture(5, 8, 8)})
    wanted = spark.createDataFrame([(1, "JPEG", 2)], "image_id long, format string, step int")
    sizes = spark.createDataFrame([(1, 8, 8)], "image_id long, width int, height int")
    for rows in (rates.scanline_sweep(pixels), rates.lossless_bits(pixels), rates.lossy_bits(rates.block_coefficients(pixels), wanted),
                 distortions(pixels, wanted), X.preview(pixels, sizes), quality.pair_pixels(pixels, pixels)):
        plan = rows._jdf.queryExecution().executedPlan().toString()  # tables as small as this one would be
        assert "Join" in plan and "Broadcast" not in plan


def test_vectors_are_spread_before_pixels_are_made_of_them(spark, sf_dir):
    from sizewise import datasets as D

    assert D.library_pixels(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_residuals_are_shuffled_once_as_counts(spark):
    pixels = table(spark, {1: picture(5, 16, 16)})
    plan = rates.scanline_sweep(pixels)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert len(exchanges) == 8
    assert not any("filter#" in e and " y#" in e for e in exchanges)  # never by line


def test_symbols_are_counted_where_they_arise(spark):
    wanted = [(1, f, 4) for f in rates.LOSSY_FORMATS]
    wants = spark.createDataFrame([(1, [(f, s) for _, f, s in wanted])], "image_id long, wants array<struct<format: string, step: int>>")
    pixels = table(spark, {1: picture(0, 64, 64)})  # 64 equal blocks, dealt by their 8 lines
    rows = rates.block_symbols(rates.block_coefficients(pixels).join(wants, "image_id").coalesce(1)).collect()
    counts = [(r.format, r.chroma, r.context, r.symbol) for r in rows]
    assert len(counts) == len(set(counts)) < 30  # a row for each symbol, not for each block
    assert sum(r.n for r in rows if r.context == rates.DC_CONTEXT) == 3 * 3 * 64


def test_wanted_twice_counts_twice_and_unknown_colours_are_grey(spark):
    p = picture(40, 8, 8)
    rows = [(1, x, y, *c) for (x, y), c in p.items()]
    rows[5] = (*rows[5][:3], None, *rows[5][4:])
    rows += [(2, x, 0, None, None, None, 255) for x in range(8)]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    wanted = spark.createDataFrame([(1, "JPEG", 5), (1, "WEBP", 5), (1, "WEBP", 5), (2, "AVIF", 5), (3, "JPEG", 5), (None, "JPEG", 5)],
                                   "image_id long, format string, step int")
    blocks = rates.block_coefficients(pixels)
    got = {(r.image_id, r.format): r.bits for r in rates.lossy_bits(blocks, wanted).collect()}
    del p[rows[5][1:3]]
    assert set(got) == {(1, "JPEG"), (1, "WEBP"), (2, "AVIF")}
    assert abs(got[1, "JPEG"] - lossy(p, "JPEG", 5)) < 1e-6
    assert got[1, "WEBP"] > 1.5 * lossy(p, "WEBP", 5)
    assert got[2, "AVIF"] == 0  # one symbol of each kind
    assert {r.left for r in blocks.where("image_id = 2").collect()} == {0} and {*blocks.where("image_id = 2").first().z} == {None}


def test_lossless_sizes_are_the_least_of_the_sweeps(spark, monkeypatch):
    """Packed bands give what rows of pixels do, with lines over several tiles and bands, pixels given twice, gaps and unknown values."""
    monkeypatch.setattr(rates, "TILE", 8)
    monkeypatch.setattr(rates, "BAND_LINES", 4)
    rng = random.Random(3)
    rows = []
    for i, (w, h, noise) in enumerate([(20, 13, 40), (9, 16, 3), (1, 1, 0), (1, 9, 5), (17, 4, 90), (16, 9, 2)]):
        rows += [(i, x, y, *[int(rng.gauss(120, noise)) % 256 for _ in range(3)], rng.choice([255, 255, 0])) for y in range(h) for x in range(w)]
    rows += rows[:60] + [(7, *r[1:]) for r in rows[::3] if r[0] == 0]
    rows += [(8, *r[1:3 + k % 4], None, *r[4 + k % 4:]) if k % 5 == 0 else (8, *r[1:]) for k, r in enumerate(rows) if r[0] == 4]
    rows += [(8, None, 3, 9, 9, 9, 255), (8, 4, None, 7, 80, 9, 255), (8, 5, None, 7, 90, 9, 255), (9, 0, 0, None, None, None, None), (None, 1, 1, 1, 1, 1, 1)]
    pixels = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int").repartition(5)
    expected = {}
    for fmt, source in (("PNG", pixels), ("WEBP", rates.without_green(pixels))):
        for r in rates.scanline_sweep(source).collect():
            expected[r.image_id, fmt] = min(expected.get((r.image_id, fmt), (math.inf, 9)), (r.bits, r.filter))
    got = {(r.image_id, r.format): (r.bits, r.filter) for r in rates.lossless_bits(pixels).collect()}
    assert got.keys() == expected.keys() and len(got) == 18
    for key, (bits, f) in expected.items():
        assert abs(got[key][0] - bits) < 1e-6 and got[key][1] == f, (key, got[key], bits, f)


def test_lossless_sizes_shuffle_pixels_once(spark):
    plan = rates.lossless_bits(table(spark, {1: picture(5, 16, 16)}))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    assert len({line.split("plan_id")[0].split("Exchange")[1].split("#")[0] for line in exchanges if "REPARTITION_BY_COL" in line}) == 1
    assert "Window" not in plan and "Generate" not in plan
