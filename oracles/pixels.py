"""Oracle SQL for pixel statistics, distortion and ladders."""

from oracles.planning import TARGET_FACTORS
from oracles.tables import IMAGE_FILES, PIXELS, PROFILES, RUNGS, SMALL_PIXELS, STRIPS, with_tables

D = "CAST({} AS DOUBLE)".format
LUMA = "(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b)"


def stats(table: str) -> str:
    return f"""
SELECT image_id, count(*) AS n_pixels, round(avg(y), 6) AS mean_luma, round(least(stddev_pop(y), 255), 6) AS contrast,
  round(avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS mean_saturation,
  round(avg(CASE WHEN y < CAST(30 AS DOUBLE) THEN 1 ELSE 0 END), 6) AS dark_region_ratio,
  round(avg(CASE WHEN y > CAST(225 AS DOUBLE) THEN 1 ELSE 0 END), 6) AS bright_region_ratio
FROM (SELECT image_id, r, g, b, {LUMA} AS y FROM {table}) GROUP BY image_id"""


PAIRS0 = PIXELS + """,
diffs AS (
  SELECT *, lead(x) OVER w AS nx, abs(lead(r) OVER w - r) + abs(lead(g) OVER w - g) + abs(lead(b) OVER w - b) + abs(lead(a) OVER w - a) AS d
  FROM pixels WINDOW w AS (PARTITION BY image_id, y ORDER BY x)
),
neighbours AS (SELECT * FROM diffs WHERE d IS NOT NULL),
islands AS (
  SELECT *, sum(CASE WHEN d < 24 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY y, x) AS island FROM neighbours
),
runs AS (
  SELECT image_id, count(*) FILTER (WHERE n >= 4) AS flat_run_count
  FROM (SELECT image_id, island, count(*) FILTER (WHERE d < 24) AS n FROM islands GROUP BY image_id, island) GROUP BY image_id
),
neighbour_stats AS (
  SELECT image_id, count(*) AS n_pairs, least(CAST(sum(d) AS DOUBLE) / count(*) / CAST(1020 AS DOUBLE), 1) AS complexity,
    count(*) FILTER (WHERE d > 120) / CAST(count(*) AS DOUBLE) AS edge_density
  FROM neighbours GROUP BY image_id
)"""


def quantized_copy(step: str, extra: str = "", source: str = "pixels") -> str:
    """Premultiplied original and quantized copy of every pixel, side by side."""
    pm = ", ".join(
        f"CAST(round({c} * a / CAST(255 AS DOUBLE)) AS INTEGER) AS {c}1, "
        f"CAST(round(least(CAST(round({c} / CAST({step} AS DOUBLE)) * {step} AS INTEGER), 255) * a / CAST(255 AS DOUBLE)) AS INTEGER) AS {c}2"
        for c in "rgb"
    )
    return f"SELECT image_id, x, y, a AS a1, a AS a2, {pm}{extra} FROM {source}"


def lumas(source: str) -> str:
    return f"""(SELECT *, CAST(0.299 AS DOUBLE) * r1 + CAST(0.587 AS DOUBLE) * g1 + CAST(0.114 AS DOUBLE) * b1 AS l1,
    CAST(0.299 AS DOUBLE) * r2 + CAST(0.587 AS DOUBLE) * g2 + CAST(0.114 AS DOUBLE) * b2 AS l2 FROM ({source}))"""


SSIM = """((2 * m1 * m2 + CAST(6.5025 AS DOUBLE)) * (2 * cov + CAST(58.5225 AS DOUBLE)))
  / ((m1 * m1 + m2 * m2 + CAST(6.5025 AS DOUBLE)) * (v1 + v2 + CAST(58.5225 AS DOUBLE)))"""
MOMENTS = "avg(l1) AS m1, avg(l2) AS m2, var_pop(l1) AS v1, var_pop(l2) AS v2, covar_pop(l1, l2) AS cov, count(*) AS n"
MSE = """CAST(sum((r1-r2)*(r1-r2) + (g1-g2)*(g1-g2) + (b1-b2)*(b1-b2) + (a1-a2)*(a1-a2)) AS DOUBLE) / (4 * count(*))"""
PSNR = "CASE WHEN mse > 0 THEN round(10 * log10(CAST(65025 AS DOUBLE) / mse), 6) END"

PAIRS = PIXELS + ", pairs AS (SELECT * FROM " + lumas(quantized_copy("16")) + ")"


def gauss(pairs: str, keys: str = "image_id") -> str:
    on = " AND ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    ck = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {keys}, avg({SSIM}) AS ssim, count(*) AS n_windows FROM (
  SELECT {keys}, m1, m2, greatest(s1 - m1 * m1, 0) AS v1, greatest(s2 - m2 * m2, 0) AS v2, s12 - m1 * m2 AS cov FROM (
    SELECT {ck}, c.x, c.y, sum(w * p.l1) AS m1, sum(w * p.l2) AS m2, sum(w * p.l1 * p.l1) AS s1, sum(w * p.l2 * p.l2) AS s2,
      sum(w * p.l1 * p.l2) AS s12, count(*) AS n
    FROM {pairs} c JOIN offsets ON true JOIN {pairs} p ON {on} AND p.x = c.x + dx AND p.y = c.y + dy
    GROUP BY {ck}, c.x, c.y) WHERE n = 121)
GROUP BY {keys}"""


KERNEL = """
taps AS (SELECT t.d, exp(-(t.d * t.d) / CAST(4.5 AS DOUBLE)) AS e FROM (SELECT unnest(range(-5, 6)) AS d) t),
offsets AS (SELECT i.d AS dx, j.d AS dy, i.e * j.e / (SELECT sum(e) * sum(e) FROM taps) AS w FROM taps i, taps j)"""

RUNG_STEPS = "rung AS (SELECT q, 1 + (100 - q) // 4 AS step FROM (VALUES (95),(85),(75),(65),(55),(45),(35)) t(q))"


def raw_sweep(step: str = "step") -> str:
    """Quantized copies without premultiplication, for every rung."""
    side = ", ".join(
        f"{c} AS {c}1, CAST(least(round({c} / CAST({step} AS DOUBLE)) * {step}, 255) AS INTEGER) AS {c}2" for c in "rgb"
    )
    return f"SELECT image_id, q, x, y, a AS a1, a AS a2, {side} FROM pixels, rung"


ENTROPY = PIXELS + "," + RUNG_STEPS + """,
cells0 AS (SELECT image_id, q, c, CAST(round(v / CAST(step AS DOUBLE)) AS INTEGER) AS value
  FROM (SELECT image_id, unnest([r, g, b]) AS v, unnest([0, 1, 2]) AS c FROM pixels), rung),
counts AS (SELECT image_id, q, c, value, count(*) AS n FROM cells0 GROUP BY image_id, q, c, value),
totals AS (SELECT image_id, q, c, CAST(sum(n) AS BIGINT) AS nn FROM counts GROUP BY image_id, q, c),
entropy AS (
  SELECT image_id, q, greatest(sum(-k.n * log2(k.n / CAST(t.nn AS DOUBLE))), 0) AS bits, max(t.nn) AS n_pixels
  FROM counts k JOIN totals t USING (image_id, q, c) GROUP BY image_id, q)"""

PROBE = ENTROPY + """,
probe_pairs AS (SELECT * FROM """ + lumas(raw_sweep()) + """ WHERE q = 75),
probe_ssim AS (SELECT image_id, avg(""" + SSIM + """) AS s FROM (
  SELECT image_id, """ + MOMENTS + """ FROM probe_pairs GROUP BY image_id, y // 8, x // 8 HAVING count(*) = 64) GROUP BY image_id),
probe AS (SELECT image_id, s AS lossy_probe_ssim, bits / n_pixels AS lossy_probe_bpp FROM entropy JOIN probe_ssim USING (image_id) WHERE q = 75)"""

# One search per image and format: a number made of both stands for the image until the end.
SEARCH = RUNGS.replace("rungs AS (", "plain_rungs AS (", 1) + "," + PROFILES + """,
wanted AS (
  SELECT image_id, least(greatest(CAST(1.5 AS DOUBLE) * """ + TARGET_FACTORS + """, CAST(0.5 AS DOUBLE)), CAST(3 AS DOUBLE)) AS target FROM profiles),
rungs AS (
  SELECT r.image_id * 2 AS image_id, q, size, damage, target FROM plain_rungs r JOIN wanted w ON w.image_id = r.image_id
  UNION ALL
  SELECT r.image_id * 2 + 1, q, CAST(floor(size * CAST(0.7 AS DOUBLE)) AS BIGINT), damage * CAST(0.9 AS DOUBLE), target
  FROM plain_rungs r JOIN wanted w ON w.image_id = r.image_id),
ladder AS (SELECT r.* FROM rungs r WHERE CASE WHEN image_id % 2 = 1 THEN q IN (80, 60, 40, 20) ELSE q IN (95, 85, 75, 65, 55, 45, 35) END),
firsts AS (SELECT image_id, max(q) FILTER (WHERE damage >= target) AS first_miss FROM ladder GROUP BY image_id),
reached AS (SELECT l.*, first_miss FROM ladder l JOIN firsts USING (image_id) WHERE first_miss IS NULL OR q >= first_miss),
scan AS (
  SELECT image_id, first_miss, min(q) FILTER (WHERE damage < target) AS lowest_pass, CAST(count(*) AS INTEGER) AS n_reached
  FROM reached GROUP BY image_id, first_miss
)"""


def _bisect(n: int) -> str:
    prev = "scan" if n == 1 else f"step{n - 1}"
    lo, hi, go = ("first_miss", "lowest_pass", "coalesce(lowest_pass > first_miss + 5, false)") if n == 1 else ("lo", "hi", "go")
    return f"""
step{n} AS (
  SELECT image_id, first_miss, lowest_pass, {"n_reached" if n == 1 else "n_reached"}, mid{n} AS m{n}, {"" if n == 1 else ", ".join(f"m{i}" for i in range(1, n)) + ","}
    ok AS go, CASE WHEN ok AND r.damage >= r.target THEN mid{n} ELSE lo0 END AS lo,
    CASE WHEN ok AND r.damage < r.target THEN mid{n} ELSE hi0 END AS hi
  FROM (SELECT *, {lo} AS lo0, {hi} AS hi0, ({lo} + {hi}) // 2 AS mid0,
      CASE WHEN {go} AND ({lo} + {hi}) // 2 > {lo} THEN ({lo} + {hi}) // 2 END AS mid{n}, {go} AND ({lo} + {hi}) // 2 > {lo} AS ok
    FROM (SELECT * {"" if n == 1 else "RENAME (lo AS lo, hi AS hi)"} FROM {prev})) s
  LEFT JOIN (SELECT image_id AS rid, q AS rq, damage, target FROM rungs) r ON rid = image_id AND rq = mid{n})"""


SQL = {
    "pixel_stats": with_tables(PIXELS) + stats("pixels"),
    "strip_stats": with_tables(STRIPS) + stats("strips"),
    "luma_histogram": with_tables(STRIPS) + f"""
SELECT image_id, CAST(least(floor({LUMA} / 8), 31) AS INTEGER) AS bin, count(*) AS n FROM strips GROUP BY 1, 2""",
    "luma_histogram_arrays": with_tables(PIXELS) + f""",
h AS (SELECT image_id, CAST(least(floor({LUMA} / 8), 31) AS INTEGER) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2),
grid AS (SELECT DISTINCT image_id, unnest(range(0, 32)) AS bin FROM h)
SELECT image_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY bin) AS luma_bins
FROM grid LEFT JOIN h USING (image_id, bin) GROUP BY image_id""",
    "color_model": with_tables(PIXELS, IMAGE_FILES) + """,
f AS (SELECT image_id, bool_or(a < 255) AS has_alpha, bool_or(a BETWEEN 1 AND 254) AS soft_alpha, bool_and(r = g AND g = b) AS gray
  FROM pixels GROUP BY image_id)
SELECT image_id, CASE WHEN format = 'GIF' THEN 'Indexed' WHEN gray AND has_alpha THEN 'GrayAlpha' WHEN gray THEN 'Gray'
  WHEN has_alpha THEN 'Rgba' ELSE 'Rgb' END AS color_model, has_alpha, soft_alpha
FROM f JOIN image_files USING (image_id)""",
    "neighbour_stats": with_tables(PAIRS0) + """
SELECT image_id, n_pairs, round(complexity, 6) AS complexity, round(1 - complexity, 6) AS compressibility,
  round(edge_density, 6) AS edge_density FROM neighbour_stats""",
    "flat_runs": with_tables(PAIRS0) + " SELECT image_id, flat_run_count FROM runs",
    "preview_pixels": with_tables(PIXELS) + """,
shown AS (SELECT unnest(range(0, 6)) AS i),
source AS (SELECT i, CAST(floor((i + CAST(0.5 AS DOUBLE)) * 16 / 6) AS INTEGER) AS s FROM shown)
SELECT image_id, CAST(sx.i AS INTEGER) AS x, CAST(sy.i AS INTEGER) AS y, r, g, b
FROM pixels p JOIN source sx ON p.x = sx.s JOIN source sy ON p.y = sy.s""",
    "build_profiles": with_tables(PROBE, PAIRS0.replace(PIXELS + ",", ""), IMAGE_FILES) + """,
st AS (
  SELECT image_id, avg(y) AS mean_luma, least(stddev_pop(y), 255) AS contrast,
    avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS sat,
    avg(CASE WHEN y < CAST(30 AS DOUBLE) THEN 1 ELSE 0 END) AS dark,
    bool_or(a < 255) AS has_alpha, bool_or(a BETWEEN 1 AND 254) AS soft_alpha, bool_and(r = g AND g = b) AS gray
  FROM (SELECT *, """ + LUMA + """ AS y FROM (SELECT image_id, r, g, b, a FROM pixels)) GROUP BY image_id
),
m AS (
  SELECT *, flat_run_count / CAST(32 AS DOUBLE) AS flat_ratio, least(complexity * (flat_run_count / CAST(32 AS DOUBLE)) * 2, 1) AS noise,
    complexity AS c, edge_density AS e, flat_run_count AS f
  FROM image_files JOIN st USING (image_id) JOIN neighbour_stats USING (image_id) JOIN runs USING (image_id) JOIN probe USING (image_id)
)
SELECT image_id, format, CASE WHEN e > CAST(0.12 AS DOUBLE) AND f > 20 AND c < CAST(0.35 AS DOUBLE) THEN 'Screenshot'
    WHEN e > CAST(0.15 AS DOUBLE) AND c < CAST(0.25 AS DOUBLE) THEN 'TextHeavy' WHEN c < CAST(0.05 AS DOUBLE) THEN 'Gradient'
    WHEN c < CAST(0.15 AS DOUBLE) AND f > 50 THEN 'Illustration' WHEN c > CAST(0.20 AS DOUBLE) THEN 'Icon'
    WHEN c < CAST(0.25 AS DOUBLE) AND format = 'PNG' THEN 'TextHeavy' ELSE 'Unknown' END AS category,
  concat_ws(',', CASE WHEN f > 100 THEN 'flat_regions' END, CASE WHEN c > CAST(0.5 AS DOUBLE) THEN 'high_noise' END,
    CASE WHEN c < CAST(0.1 AS DOUBLE) THEN 'smooth' END, CASE WHEN c > CAST(0.3 AS DOUBLE) AND c < CAST(0.5 AS DOUBLE) THEN 'sharp_edges' END,
    CASE WHEN has_alpha THEN 'transparency' END, CASE WHEN soft_alpha THEN 'soft_alpha' END,
    CASE WHEN sat > CAST(0.6 AS DOUBLE) THEN 'highly_saturated' END, CASE WHEN dark > CAST(0.4 AS DOUBLE) THEN 'predominantly_dark' END,
    CASE WHEN flat_ratio > CAST(0.3 AS DOUBLE) THEN 'large_flat_areas' END, CASE WHEN noise > CAST(0.3 AS DOUBLE) THEN 'noisy' END,
    CASE WHEN e > CAST(0.15 AS DOUBLE) THEN 'text_or_ui' END) AS tags,
  CASE WHEN gray AND has_alpha THEN 'GrayAlpha' WHEN gray THEN 'Gray' WHEN has_alpha THEN 'Rgba' ELSE 'Rgb' END AS color_model,
  round(mean_luma, 6) AS mean_luma, round(contrast, 6) AS contrast, round(c, 6) AS complexity, round(e, 6) AS edge_density,
  flat_run_count, round(flat_ratio, 6) AS flat_region_ratio, round(noise, 6) AS noise_estimate,
  round(lossy_probe_ssim, 6) AS lossy_probe_ssim, round(lossy_probe_bpp, 6) AS lossy_probe_bpp
FROM m""",
    "mse_psnr": with_tables(PAIRS) + f""",
e AS (SELECT image_id, {MSE} AS mse FROM pairs GROUP BY image_id)
SELECT image_id, round(mse, 6) AS mse, {PSNR} AS psnr, mse = 0 AS is_lossless FROM e""",
    "ssim_block": with_tables(PAIRS) + f"""
SELECT image_id, round(avg({SSIM}), 6) AS ssim, count(*) AS n_blocks FROM (
  SELECT image_id, {MOMENTS} FROM pairs GROUP BY image_id, y // 8, x // 8 HAVING count(*) = 64) GROUP BY image_id""",
    "ssim_gauss": with_tables(PAIRS, KERNEL) + f"""
SELECT image_id, round(ssim, 6) AS ssim, n_windows FROM ({gauss('pairs')})""",
    "ssim_global": with_tables(SMALL_PIXELS, "pairs AS (SELECT * FROM " + lumas(quantized_copy("16")) + ")") + f"""
SELECT image_id, round({SSIM}, 6) AS ssim FROM (SELECT image_id, {MOMENTS} FROM pairs GROUP BY image_id)""",
    "evaluate_outputs": with_tables(
        PIXELS, "pairs AS (SELECT * FROM " + lumas(quantized_copy("32")) + ")", KERNEL
    ) + f""",
e AS (SELECT image_id, {MSE} AS mse FROM pairs GROUP BY image_id),
s AS ({gauss('pairs')})
SELECT image_id, 'b' AS candidate_id, round(mse, 6) AS mse, {PSNR} AS psnr, round(ssim, 6) AS ssim, mse = 0 AS is_lossless
FROM e JOIN s USING (image_id)
UNION ALL SELECT image_id, 'a', CAST(0 AS DOUBLE), NULL, CAST(1 AS DOUBLE), true FROM e""",
    "quantize_sweep": with_tables(
        PIXELS, RUNG_STEPS, "pairs AS (SELECT * FROM " + lumas(quantized_copy("step", ", q", "pixels, rung")) + ")"
    ) + f""",
e AS (SELECT image_id, q, {MSE} AS mse FROM pairs GROUP BY image_id, q),
s AS (SELECT image_id, q, avg({SSIM}) AS ssim FROM (
  SELECT image_id, q, {MOMENTS} FROM pairs GROUP BY image_id, q, y // 8, x // 8 HAVING count(*) = 64) GROUP BY image_id, q)
SELECT image_id, q, round(mse, 6) AS mse, {PSNR} AS psnr, round(ssim, 6) AS ssim FROM e JOIN s USING (image_id, q)""",
    "rung_entropy": with_tables(ENTROPY) + " SELECT image_id, q, round(bits, 4) AS bits, n_pixels FROM entropy",
    "lossy_probe": with_tables(PROBE) + """
SELECT image_id, round(lossy_probe_ssim, 6) AS lossy_probe_ssim, round(lossy_probe_bpp, 6) AS lossy_probe_bpp FROM probe""",
    "ladder_scan": with_tables(SEARCH) + """
SELECT image_id // 2 AS image_id, CASE WHEN image_id % 2 = 1 THEN 'AVIF' ELSE 'JPEG' END AS format, first_miss, lowest_pass, n_reached FROM scan""",
    "ladder_search": with_tables(SEARCH, _bisect(1), _bisect(2), _bisect(3)) + """,
tried AS (
  SELECT image_id, q FROM reached
  UNION ALL SELECT image_id, unnest([m1, m2, m3]) FROM step3
),
measured AS (SELECT t.image_id, r.q, r.size, r.damage, r.target FROM tried t JOIN rungs r ON r.image_id = t.image_id AND r.q = t.q),
counted AS (SELECT image_id, CAST(count(*) AS INTEGER) AS n_tried, max(q) AS top, min(target) AS target FROM measured GROUP BY image_id),
best AS (
  SELECT image_id, q, size, damage FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size, damage) AS rn FROM measured WHERE damage < target) WHERE rn = 1
)
SELECT c.image_id // 2 AS image_id, CASE WHEN c.image_id % 2 = 1 THEN 'AVIF' ELSE 'JPEG' END AS format, round(c.target, 6) AS target, coalesce(b.q, m.q) AS q, coalesce(b.size, m.size) AS size, round(coalesce(b.damage, m.damage), 6) AS damage, n_tried,
  b.q IS NOT NULL AS converged
FROM counted c LEFT JOIN best b USING (image_id) LEFT JOIN measured m ON m.image_id = c.image_id AND m.q = c.top AND b.q IS NULL""",
    "png_headers": """
WITH heads AS (
  SELECT doc_id AS image_id, doc_id % 5000 AS w, 1 + doc_id % 3000 AS h, [8, 16, 1][1 + doc_id % 3] AS depth, [0, 2, 3, 4, 6, 5][1 + doc_id % 6] AS kind,
    doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS whole FROM documents),
read_heads AS (
  SELECT *, CASE kind WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 6 THEN 4 END AS channels FROM heads)
SELECT image_id, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height,
  CASE WHEN ok THEN w * h * channels * ((depth + 7) // 8) END AS raw_size
FROM (SELECT *, whole AND w > 0 AND channels IS NOT NULL AS ok FROM read_heads)""",
    # A head that is cut off has lost its dimensions, but for PNG; of AVIF the smaller ones before them are left.
    "pixels_over_white": with_tables(PIXELS) + " SELECT image_id, x, y, " + ", ".join(
        f"CAST(round(({c} * a + 255 * (255 - a)) / CAST(255 AS DOUBLE)) AS INTEGER) AS {c}" for c in "rgb") + " FROM pixels",
    "image_sizes": """
SELECT doc_id AS image_id, ['PNG', 'JPEG', 'WEBP', 'WEBP', 'WEBP', 'AVIF', 'GIF', 'BMP', 'TIFF'][1 + kind] AS format,
  CASE WHEN known THEN w WHEN kind = 5 THEN least(w, 8) END AS width, CASE WHEN known THEN h WHEN kind = 5 THEN least(h, 8) END AS height
FROM (SELECT doc_id, doc_id % 9 AS kind, doc_id % 13 <> 0 OR doc_id % 9 = 0 AS known, 1 + doc_id * 37 % 5000 AS w, 1 + doc_id * 61 % 4000 AS h FROM documents)""",
}
