"""Oracle SQL for the chain of a library: rates by format, scanline filters, perceptual damage, searches, decisions."""

import math

from oracles.decisions import ANNOTATED, DECIDED
from oracles.pixels import LUMA, MOMENTS, MSE, PAIRS0, PROBE, RUNG_STEPS, SEARCH, SSIM, _bisect, lumas, quantized_copy
from oracles.planning import APPLIES, CANDIDATES, LABEL, TARGET_FACTORS
from oracles.tables import GOALS, IMAGE_FILES, MEASUREMENTS, PIXELS, PROFILES, with_tables

LIBRARY_PIXELS = """
cells AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
placed AS (SELECT *, unnest(range(greatest(vec_id - 56, 0) // 8, vec_id // 8 + 1)) AS i FROM cells),
pixels AS (
  SELECT i AS image_id, CAST(x AS INTEGER) AS x, CAST(vec_id - 8 * i AS INTEGER) AS y,
    CAST(least(greatest(round(base + slope + gain * v), 0), 255) AS INTEGER) AS r,
    CAST(least(greatest(round(base + slope + gain * CAST(0.5 AS DOUBLE) * v), 0), 255) AS INTEGER) AS g,
    CAST(least(greatest(round(base + slope + gain * CAST(-0.5 AS DOUBLE) * v), 0), 255) AS INTEGER) AS b,
    CASE WHEN i % 4 = 3 AND x < 4 THEN 128 ELSE 255 END AS a
  FROM (
    SELECT *, CAST(CASE WHEN i % 7 = 0 THEN 1200 WHEN i % 5 = 0 THEN 60 WHEN i % 3 = 1 THEN 20 ELSE 300 END AS DOUBLE) AS gain,
      CAST(CASE WHEN i % 5 = 0 THEN 20 ELSE 128 END AS DOUBLE) AS base,
      CAST(CASE WHEN i % 2 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) * (x - 32) AS slope
    FROM placed WHERE i IN (SELECT (vec_id - 63) // 8 FROM embeddings WHERE vec_id % 8 = 7 AND vec_id >= 63)))"""

LIBRARY_FILES = """
image_files AS (
  SELECT i AS image_id, ['PNG', 'JPEG', 'WEBP', 'BMP', 'TIFF'][1 + i % 5] AS format, 64 AS width, 64 AS height, 2000 + (i * 7919) % 30000 AS file_size
  FROM (SELECT (vec_id - 63) // 8 AS i FROM embeddings WHERE vec_id % 8 = 7 AND vec_id >= 63))"""

# The cosine transform of eight values in whole numbers, and the order of places along the diagonals.
_BASIS = [[round(math.sqrt((1 if u == 0 else 2) / 8) * 1024 * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)]
_DIAGONALS = sorted(((v, u) for v in range(8) for u in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
_PLACE = [_DIAGONALS.index((v, u)) for v in range(8) for u in range(8)]


def _level(z: str, step: str) -> str:
    unit = f"({step} * 1048576)"
    return f"(CASE WHEN {z} < 0 THEN -1 ELSE 1 END * ((abs({z}) + {unit} // 2) // {unit}))"


BLOCKS = f"""
components AS (
  SELECT image_id, x, y, unnest([0, 1, 2]) AS c, unnest([
    CAST(floor((77 * r + 150 * g + 29 * b + 128) / CAST(256 AS DOUBLE)) AS BIGINT) - 128,
    CAST(floor((-43 * r - 85 * g + 128 * b + 128) / CAST(256 AS DOUBLE)) AS BIGINT),
    CAST(floor((128 * r - 107 * g - 21 * b + 128) / CAST(256 AS DOUBLE)) AS BIGINT)]) AS v FROM pixels),
along AS (SELECT image_id, c, y // 8 AS brow, x // 8 AS bx, y % 8 AS j, u, CAST(sum(({_BASIS})[u + 1][x % 8 + 1] * v) AS BIGINT) AS h
  FROM components, (SELECT unnest(range(0, 8)) AS u) GROUP BY ALL),
down AS (SELECT image_id, c, brow, bx, u, w, CAST(sum(({_BASIS})[w + 1][j + 1] * h) AS BIGINT) AS z
  FROM along, (SELECT unnest(range(0, 8)) AS w) GROUP BY ALL),
whole AS (SELECT image_id, c, brow, bx, list(z ORDER BY ({_PLACE})[w * 8 + u + 1]) AS z FROM down GROUP BY ALL),
blocks AS (SELECT *, coalesce(lag(z[1]) OVER (PARTITION BY image_id, c, brow ORDER BY bx), 0) AS lft FROM whole)"""


def rates(steps: str) -> str:
    """Bits of every image in every lossy format at the given steps."""
    band = "(" + " + ".join(f"(CASE WHEN i > {b} THEN 1 ELSE 0 END)" for b in (2, 5, 9, 20)) + ")"
    return BLOCKS + f""",
leveled AS (
  SELECT image_id, c > 0 AS chroma, step, list_transform(z, lambda e: {_level('e', 'step')}) AS lv, {_level('lft', 'step')} AS dc
  FROM blocks, {steps}),
used AS (SELECT *, list_filter(range(1, 64), lambda i: lv[i + 1] <> 0) AS nz FROM leveled),
coded AS (
  SELECT image_id, chroma, step, lv, nz, lv[1] - dc AS first, coalesce(nz[len(nz)], 0) AS final FROM used),
symbols AS (
  SELECT image_id, 'JPEG' AS format, chroma, step, 0 AS context, unnest(list_append(list_transform(range(1, len(nz) + 1),
    lambda k: (nz[k] - (CASE WHEN k > 1 THEN nz[k - 1] ELSE 0 END) - 1) * 100000 + lv[nz[k] + 1] + 50000), -1)) AS symbol FROM coded
  UNION ALL SELECT image_id, f, chroma, step, 1, first FROM coded, (VALUES ('JPEG'), ('WEBP'), ('AVIF')) t(f)
  UNION ALL SELECT image_id, f, chroma, step, 2, final FROM coded, (VALUES ('WEBP'), ('AVIF')) t(f)
  UNION ALL SELECT image_id, 'WEBP', chroma, step, 10 + 2 * {band}, lv[i + 1] FROM (SELECT *, unnest(range(1, final + 1)) AS i FROM coded)
  UNION ALL SELECT image_id, 'AVIF', chroma, step, 10 + 2 * {band} + (CASE WHEN i > 1 AND lv[i] <> 0 THEN 1 ELSE 0 END), lv[i + 1]
    FROM (SELECT *, unnest(range(1, final + 1)) AS i FROM coded)),
symbol_counts AS (SELECT image_id, format, step, chroma, context, symbol, count(*) AS n FROM symbols GROUP BY ALL),
context_bits AS (
  SELECT image_id, format, step, CAST(sum(n) AS DOUBLE) * log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) + (count(*) - 1) / CAST(2 AS DOUBLE) * log2(CAST(sum(n) AS DOUBLE)) AS bits
  FROM symbol_counts GROUP BY image_id, format, step, chroma, context),
rates AS (SELECT image_id, format, step, round(greatest(sum(bits), 0), 9) AS bits FROM context_bits GROUP BY ALL)"""


def scanlines(source: str, name: str) -> str:
    """Bits of every image under each line filter."""
    near = """CASE WHEN abs(above - corner) <= abs(lft - corner) AND abs(above - corner) <= abs(lft + above - 2 * corner) THEN lft
      WHEN abs(lft - corner) <= abs(lft + above - 2 * corner) THEN above ELSE corner END"""
    return f"""
{name}_cells AS (SELECT image_id, x, y, unnest([0, 1, 2, 3]) AS ch, unnest([r, g, b, a]) AS v FROM {source}),
{name}_left AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, ch, y ORDER BY x), 0) AS lft FROM {name}_cells),
{name}_near AS (SELECT *, coalesce(lag(v) OVER w, 0) AS above, coalesce(lag(lft) OVER w, 0) AS corner FROM {name}_left
  WINDOW w AS (PARTITION BY image_id, ch, x ORDER BY y)),
{name}_res AS (SELECT image_id, y, ch, unnest([0, 1, 2, 3, 4]) AS filter,
  unnest([v, (v - lft + 256) % 256, (v - above + 256) % 256, (v - (lft + above) // 2 + 256) % 256, (v - ({near}) + 256) % 256]) AS residual FROM {name}_near),
{name}_lines AS (SELECT image_id, y, filter, ch, residual, count(*) AS n FROM {name}_res GROUP BY ALL),
{name}_costs AS (SELECT image_id, y, filter, sum(least(residual, 256 - residual) * n) AS cost FROM {name}_lines GROUP BY ALL),
{name}_chosen AS (SELECT image_id, y, filter FROM {name}_costs QUALIFY row_number() OVER (PARTITION BY image_id, y ORDER BY cost, filter) = 1),
{name}_counts AS (
  SELECT image_id, filter, ch, residual, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT * FROM {name}_lines
    UNION ALL SELECT l.* REPLACE (5 AS filter) FROM {name}_lines l JOIN {name}_chosen USING (image_id, y, filter)) GROUP BY ALL),
{name}_parts AS (SELECT image_id, filter, CAST(sum(n) AS DOUBLE) * log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) + (count(*) - 1) / CAST(2 AS DOUBLE) * log2(CAST(sum(n) AS DOUBLE)) AS bits
  FROM {name}_counts GROUP BY image_id, filter, ch),
{name} AS (
  SELECT image_id, filter, round(greatest(sum(bits) + (CASE WHEN filter = 5 THEN 3 * any_value(naming) ELSE 0 END), 0), 9) AS bits
  FROM {name}_parts JOIN (SELECT image_id, count(*) AS naming FROM {name}_chosen GROUP BY 1) USING (image_id) GROUP BY image_id, filter)"""


LOSSLESS = scanlines("pixels", "png") + "," + scanlines(
    "(SELECT image_id, x, y, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b, a FROM pixels)", "webp") + """,
lossless AS (
  SELECT * FROM (SELECT 'PNG' AS format, * FROM png UNION ALL SELECT 'WEBP', * FROM webp)
  QUALIFY row_number() OVER (PARTITION BY image_id, format ORDER BY bits, filter) = 1)"""


def damages(pairs: str = "pairs", key: str = "step") -> str:
    """Damage over three scales of a table of pairs."""
    halves = "".join(f"""
scale{s} AS (SELECT image_id, {key}, x // 2 AS x, y // 2 AS y, avg(l1) AS l1, avg(l2) AS l2 FROM scale{s - 1} GROUP BY image_id, {key}, x // 2, y // 2),"""
                     for s in (1, 2))
    means = " UNION ALL ".join(f"""
  SELECT image_id, {key}, avg({SSIM}) AS s FROM (SELECT image_id, {key}, {MOMENTS} FROM scale{s} GROUP BY image_id, {key}, y // 8, x // 8) GROUP BY ALL""" for s in (0, 1, 2))
    return f"""
scale0 AS (SELECT image_id, {key}, x, y, l1, l2 FROM {pairs}),{halves}
damages AS (SELECT image_id, {key}, round(100 * (1 - avg(s)), 9) AS damage FROM ({means}) GROUP BY ALL)"""


# Profiles measured on the pixels of the library, in place of the given ones.
_TAGS = """list_filter([CASE WHEN f > 100 THEN 'flat_regions' END, CASE WHEN c > CAST(0.5 AS DOUBLE) THEN 'high_noise' END,
    CASE WHEN c < CAST(0.1 AS DOUBLE) THEN 'smooth' END, CASE WHEN c > CAST(0.3 AS DOUBLE) AND c < CAST(0.5 AS DOUBLE) THEN 'sharp_edges' END,
    CASE WHEN has_alpha THEN 'transparency' END, CASE WHEN soft_alpha THEN 'soft_alpha' END,
    CASE WHEN sat > CAST(0.6 AS DOUBLE) THEN 'highly_saturated' END, CASE WHEN dark > CAST(0.4 AS DOUBLE) THEN 'predominantly_dark' END,
    CASE WHEN flat_ratio > CAST(0.3 AS DOUBLE) THEN 'large_flat_areas' END, CASE WHEN noise > CAST(0.3 AS DOUBLE) THEN 'noisy' END,
    CASE WHEN e > CAST(0.15 AS DOUBLE) THEN 'text_or_ui' END], lambda t: t IS NOT NULL)"""
BUILT = ",".join([PROBE.replace(PIXELS, LIBRARY_PIXELS), PAIRS0.replace(PIXELS + ",", ""), LIBRARY_FILES]) + """,
st AS (
  SELECT image_id, avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS sat,
    avg(CASE WHEN y < CAST(30 AS DOUBLE) THEN 1 ELSE 0 END) AS dark, bool_or(a < 255) AS has_alpha, bool_or(a BETWEEN 1 AND 254) AS soft_alpha
  FROM (SELECT image_id, r, g, b, a, """ + LUMA + """ AS y FROM (SELECT image_id, r, g, b, a FROM pixels)) GROUP BY image_id),
m AS (
  SELECT *, flat_run_count / CAST(128 AS DOUBLE) AS flat_ratio, least(complexity * (flat_run_count / CAST(128 AS DOUBLE)) * 2, 1) AS noise,
    complexity AS c, edge_density AS e, flat_run_count AS f
  FROM image_files JOIN st USING (image_id) JOIN neighbour_stats USING (image_id) JOIN runs USING (image_id) JOIN probe USING (image_id)),
profiles AS (
  SELECT image_id, format, width, height, file_size, c AS complexity, e AS edge_density, f AS flat_run_count, dark AS dark_region_ratio, noise AS noise_estimate,
    has_alpha, false AS is_animated, 4096 AS pixel_count, lossy_probe_ssim, lossy_probe_bpp, """ + _TAGS + """ AS characteristics,
    CASE WHEN e > CAST(0.12 AS DOUBLE) AND f > 20 AND c < CAST(0.35 AS DOUBLE) THEN 'Screenshot'
      WHEN e > CAST(0.15 AS DOUBLE) AND c < CAST(0.25 AS DOUBLE) THEN 'TextHeavy' WHEN c < CAST(0.05 AS DOUBLE) THEN 'Gradient'
      WHEN c < CAST(0.15 AS DOUBLE) AND f > 50 THEN 'Illustration' WHEN c > CAST(0.20 AS DOUBLE) THEN 'Icon'
      WHEN c < CAST(0.25 AS DOUBLE) AND format = 'PNG' THEN 'TextHeavy' ELSE 'Unknown' END AS category
  FROM m)"""
PLANNED = CANDIDATES.replace(PROFILES, BUILT, 1)

ALL_STEPS = "(SELECT unnest(range(1, 22)) AS step)"
MEASURED = PLANNED + "," + rates(ALL_STEPS + " steps") + "," + LOSSLESS + """,
pairs AS (SELECT * FROM """ + lumas(quantized_copy("step", ", step", "pixels, " + ALL_STEPS)) + """),
e AS (SELECT image_id, step, """ + MSE + """ AS mse FROM pairs GROUP BY image_id, step),
s AS (SELECT image_id, step, avg(""" + SSIM + """) AS ssim FROM (
  SELECT image_id, step, """ + MOMENTS + """ FROM pairs GROUP BY image_id, step, y // 8, x // 8 HAVING count(*) = 64) GROUP BY image_id, step),""" + damages()

# Each image, goal and format that searches, evaluated on all qualities at once; a number of its own stands for the image.
SEARCHED = MEASURED + """,
wanting AS (
  SELECT row_number() OVER (ORDER BY image_id, goal, f) AS image_id, image_id AS img, goal, f,
    least(greatest(target * """ + TARGET_FACTORS + """, CAST(0.5 AS DOUBLE)), CAST(3 AS DOUBLE)) AS target
  FROM candidates WHERE reason IS NULL AND kind = 'search'),
rungs AS (
  SELECT w.image_id, q, CAST(64 + ceil(r.bits / 8) AS BIGINT) AS size, d.damage, w.target, w.f
  FROM wanting w, (SELECT CAST(unnest(range(20, 96)) AS INTEGER) AS q) t, rates r, damages d
  WHERE r.image_id = img AND r.format = f AND r.step = 1 + (100 - q) // 4 AND d.image_id = img AND d.step = r.step),
ladder AS (SELECT * FROM rungs WHERE CASE WHEN f = 'AVIF' THEN q IN (80, 60, 40, 20) ELSE q IN (95, 85, 75, 65, 55, 45, 35) END),
""" + SEARCH[SEARCH.index("firsts AS"):] + "," + ",".join(_bisect(n) for n in (1, 2, 3)) + """,
tried AS (SELECT image_id, q FROM reached UNION ALL SELECT image_id, unnest([m1, m2, m3]) FROM step3),
measured AS (SELECT t.image_id, r.q, r.size, r.damage, r.target FROM tried t JOIN rungs r ON r.image_id = t.image_id AND r.q = t.q),
counted AS (SELECT image_id, CAST(count(*) AS INTEGER) AS n_tried, max(q) AS top FROM measured GROUP BY image_id),
smallest AS (SELECT image_id, q, size, damage FROM measured WHERE damage < target QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY size, damage, q) = 1),
found AS (
  SELECT w.img, w.goal, w.f, coalesce(b.q, m.q) AS quality, coalesce(b.size, m.size) AS size, coalesce(b.damage, m.damage) AS damage, n_tried, b.q IS NOT NULL AS converged
  FROM wanting w JOIN counted c USING (image_id) LEFT JOIN smallest b USING (image_id)
  LEFT JOIN measured m ON m.image_id = c.image_id AND m.q = c.top AND b.q IS NULL)"""

LIBRARY = "measurements AS (WITH " + SEARCHED + """,
measurable AS (
  SELECT c.*, """ + LABEL + """ AS label, CASE WHEN kind = 'search' THEN x.quality WHEN NOT ll THEN coalesce(q, 90) END AS lq, x.damage AS found_damage,
    kind = 'search' OR """ + APPLIES + """ AS applies
  FROM costed c LEFT JOIN (SELECT img, goal AS sgoal, f AS sf, quality, damage FROM found) x ON img = c.image_id AND sgoal = c.goal AND sf = c.f AND c.kind = 'search' WHERE reason IS NULL),
stepped AS (SELECT *, CASE WHEN ll THEN 1 ELSE 1 + (100 - lq) // 4 END AS step FROM measurable),
compared AS (
  SELECT p.*, CASE WHEN p.ll THEN z.bits ELSE r.bits END AS bits, e.mse, s.ssim, d.damage AS step_damage
  FROM stepped p LEFT JOIN e ON e.image_id = p.image_id AND e.step = p.step LEFT JOIN s ON s.image_id = p.image_id AND s.step = p.step
    LEFT JOIN damages d ON d.image_id = p.image_id AND d.step = p.step
    LEFT JOIN rates r ON NOT p.ll AND r.image_id = p.image_id AND r.format = p.f AND r.step = p.step
    LEFT JOIN lossless z ON p.ll AND z.image_id = p.image_id AND z.format = p.f),
checked AS (SELECT *, CASE WHEN NOT applies THEN 'not_applicable' WHEN mse IS NULL THEN 'no_pixels' WHEN bits IS NULL THEN 'no_size' END AS error FROM compared)
SELECT image_id, printf('%03d', position) || '-' || replace(label, ' ', '-') AS candidate_id, goal, file_size AS original_size,
  CASE WHEN error IS NULL THEN CAST(64 + ceil(bits / 8) AS BIGINT) END AS output_size, f AS format, ll AS lossless, kind = 'search' AS iterative,
  lq AS quality, error IS NULL AS success, CASE WHEN error IS NULL THEN ssim END AS ssim,
  CASE WHEN error IS NULL AND mse > 0 THEN 10 * log10(CAST(65025 AS DOUBLE) / mse) END AS psnr, CASE WHEN error IS NULL THEN mse END AS mse,
  CASE WHEN error IS NULL THEN CASE WHEN kind = 'search' THEN found_damage
    WHEN NOT ll AND mse > 0 AND ssim IS NOT NULL AND (gate OR ssim BETWEEN CAST(0.85 AS DOUBLE) AND CAST(0.95 AS DOUBLE)) THEN step_damage END END AS perceptual,
  cost AS estimated_cost_ms, category IN ('Photograph', 'HighlyDetailed', 'Unknown') AS photo_like, lossy_probe_ssim, error FROM checked)"""


def _library(text: str) -> str:
    return with_tables(text.replace(MEASUREMENTS, LIBRARY, 1).replace("THEN 'backend_error'", "THEN coalesce(error, 'backend_error')").replace(
        "reason IN ('backend_error')", "NOT success"))


RUNG_TABLE = f"({RUNG_STEPS[len('rung AS ('):-1]}) rung"
SQL = {
    "library_decisions": _library(DECIDED) + """
SELECT image_id, goal, outcome, kept_original, preference_fired, original_size, final_size, candidate_id, format, quality,
  lossless, n_candidates, n_measured, n_survivors FROM decided""",
    "library_totals": _library(DECIDED) + """
SELECT goal, count(*) AS images, count(*) FILTER (WHERE outcome = 'selected') AS selected, count(*) FILTER (WHERE outcome = 'all_failed') AS failed,
  CAST(sum(original_size) AS BIGINT) AS original_bytes, CAST(sum(final_size) AS BIGINT) AS final_bytes FROM decided GROUP BY goal""",
    "library_rejections": _library(ANNOTATED) + """
SELECT goal, stage, reason, format, count(*) AS n FROM (
  SELECT goal, CASE WHEN dominated THEN 'front' ELSE stage END AS stage, CASE WHEN dominated THEN 'dominated' ELSE reason END AS reason, format
  FROM annotated WHERE NOT survives
  UNION ALL
  SELECT goal, CASE reason WHEN 'same_decade' THEN 'ex_ante' WHEN 'over_cap' THEN 'cap' ELSE 'rule' END, reason, f FROM (
    WITH """ + PLANNED + """ SELECT * FROM candidates) WHERE reason IS NOT NULL)
GROUP BY ALL""",
    "library_searches": with_tables(SEARCHED) + """
SELECT img AS image_id, goal, f AS format, quality, size, round(damage, 6) AS damage, n_tried, converged FROM found""",
    "scanline_sweep": with_tables(PIXELS, scanlines("pixels", "png")) + " SELECT image_id, filter, round(bits, 4) AS bits FROM png",
    "lossless_sizes": with_tables(LIBRARY_PIXELS, LOSSLESS) + " SELECT image_id, format, round(bits, 4) AS bits, filter FROM lossless",
    "lossy_rates": with_tables(LIBRARY_PIXELS, rates(RUNG_TABLE)) + " SELECT image_id, format, CAST(step AS INTEGER) AS step, round(bits, 4) AS bits FROM rates",
    "perceptual_damage": with_tables(
        PIXELS, RUNG_STEPS, "pairs AS (SELECT * FROM " + lumas(quantized_copy("step", ", q", "pixels, rung")) + ")", damages("pairs", "q")
    ) + " SELECT image_id, q, round(damage, 6) AS damage FROM damages",
}
