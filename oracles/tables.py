"""The derived tables again, as SQL common table expressions for the oracle engine."""

from sizewise.datasets import PROMPTS


def texts(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MEASUREMENTS = """
measurements AS (
  SELECT l_orderkey AS image_id,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT),
              datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS candidate_id,
    CASE l_orderkey % 6 WHEN 0 THEN 'LOSSLESS' WHEN 1 THEN 'QUALITY' WHEN 2 THEN 'BALANCED' WHEN 3 THEN 'MAXIMUM'
      WHEN 4 THEN 'WEB' ELSE 'EXTREME' END AS goal,
    CAST(floor(o_totalprice * 10) AS BIGINT) AS original_size,
    CAST(floor(l_extendedprice * (3 + l_partkey % 40)) AS BIGINT) AS output_size,
    fmt AS format, is_ll AS lossless,
    (NOT is_ll) AND l_linestatus = 'F' AS iterative,
    CASE WHEN NOT is_ll THEN CAST(20 + (l_suppkey * 7) % 76 AS INTEGER) END AS quality,
    l_partkey % 29 <> 0 AS success,
    CASE WHEN l_suppkey % 11 <> 0 THEN CAST(0.999 AS DOUBLE) - CAST(3.7 AS DOUBLE) * l_discount END AS ssim,
    CASE WHEN l_suppkey % 11 <> 0 THEN CAST(22 AS DOUBLE) + CAST(300 AS DOUBLE) * l_tax END AS psnr,
    CAST(NULL AS DOUBLE) AS mse,
    CASE WHEN CAST(l_quantity AS INTEGER) % 3 <> 0
      THEN CAST(0.21 AS DOUBLE) + l_quantity / CAST(17 AS DOUBLE) END AS perceptual,
    50 + (l_partkey * 31) % 9000 AS estimated_cost_ms,
    l_orderkey % 2 = 0 AS photo_like,
    CASE WHEN l_orderkey % 5 <> 0
      THEN CAST(0.90 AS DOUBLE) + (l_orderkey % 13) * CAST(0.0077 AS DOUBLE) END AS lossy_probe_ssim
  FROM (SELECT *, fmt = 'PNG' OR (fmt = 'WEBP' AND l_returnflag = 'R') AS is_ll
        FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'WEBP' ELSE 'AVIF' END AS fmt
              FROM lineitem)) li
  JOIN orders ON l_orderkey = o_orderkey
)"""

GOALS = """
goals AS (
  SELECT goal, CAST(wq AS DOUBLE) wq, CAST(wc AS DOUBLE) wc, CAST(ws AS DOUBLE) ws, CAST(wk AS DOUBLE) wk,
    CAST(minq AS DOUBLE) minq, lossy, pref, maxc, budget, CAST(target AS DOUBLE) target, searches, gate, meta
  FROM (VALUES
    ('LOSSLESS', 1.0, 0.2, 0.2, 0.5, 1.0, false, ['PNG','WEBP'], 4, 30000, 0.0, false, false, 'Keep'),
    ('QUALITY', 0.85, 0.30, 0.20, 0.40, 0.92, true, ['WEBP','AVIF','PNG'], 6, 60000, 0.75, true, false, 'Keep'),
    ('BALANCED', 0.50, 0.70, 0.40, 0.40, 0.80, true, ['WEBP','AVIF','PNG','JPEG'], 10, 60000, 1.5, false, false, 'RemoveSafe'),
    ('MAXIMUM', 0.10, 1.0, 0.20, 0.30, 0.75, true, ['AVIF','WEBP','JPEG'], 12, 120000, 3.0, true, true, 'RemoveSafe'),
    ('WEB', 0.40, 0.85, 0.70, 0.95, 0.75, true, ['WEBP','JPEG','PNG'], 5, 30000, 1.5, false, false, 'RemoveSafe'),
    ('EXTREME', 0.40, 1.0, 0.10, 0.20, 0.90, true, ['WEBP','AVIF','JPEG','PNG'], 16, 180000, 1.0, true, false, 'RemoveSafe')
  ) t(goal, wq, wc, ws, wk, minq, lossy, pref, maxc, budget, target, searches, gate, meta)
)"""

PROFILES = """
profiles0 AS (
  SELECT p_partkey AS image_id,
    CASE p_partkey % 7 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'WEBP' WHEN 3 THEN 'AVIF' WHEN 4 THEN 'GIF'
      WHEN 5 THEN 'BMP' ELSE 'TIFF' END AS format,
    CAST(16 + (p_partkey * 97) % 1500 AS INTEGER) AS width, CAST(16 + (p_partkey * 61) % 1200 AS INTEGER) AS height,
    1024 + (p_partkey * 7919) % 900000 + CASE WHEN p_partkey % 211 = 0 THEN 62914560 ELSE 0 END AS file_size,
    CAST(p_partkey * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.6 AS DOUBLE) AS complexity,
    CAST(p_partkey * 53 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS edge_density,
    CAST((p_partkey * 71) % 150 AS INTEGER) AS flat_run_count,
    CAST(p_partkey * 29 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS dark_region_ratio,
    CAST(p_partkey * 43 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS mean_saturation,
    CAST(p_partkey * 17 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(0.6 AS DOUBLE) AS noise_estimate,
    p_partkey % 4 = 1 AS has_alpha,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(0.90 AS DOUBLE) + (p_partkey % 13) * CAST(0.0077 AS DOUBLE) END AS lossy_probe_ssim,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(0.1 AS DOUBLE) + (p_partkey % 50) * CAST(0.05 AS DOUBLE) END AS lossy_probe_bpp
  FROM part
),
profiles1 AS (
  SELECT *, CAST(flat_run_count AS DOUBLE) / (CAST(2 AS DOUBLE) * height) AS flat_region_ratio, format = 'GIF' AS is_animated,
    CAST(width AS BIGINT) * height AS pixel_count
  FROM profiles0
),
profiles AS (
  SELECT *,
    CASE
      WHEN edge_density > CAST(0.12 AS DOUBLE) AND flat_run_count > 20 AND complexity < CAST(0.35 AS DOUBLE) THEN 'Screenshot'
      WHEN edge_density > CAST(0.15 AS DOUBLE) AND complexity < CAST(0.25 AS DOUBLE) THEN 'TextHeavy'
      WHEN complexity < CAST(0.05 AS DOUBLE) THEN 'Gradient'
      WHEN complexity < CAST(0.15 AS DOUBLE) AND flat_run_count > 50 THEN 'Illustration'
      WHEN complexity > CAST(0.45 AS DOUBLE) AND pixel_count > 500000 THEN 'HighlyDetailed'
      WHEN complexity > CAST(0.30 AS DOUBLE) AND pixel_count > 200000 THEN 'GameTexture'
      WHEN complexity > CAST(0.20 AS DOUBLE) AND pixel_count < 50000 THEN 'Icon'
      WHEN dark_region_ratio > CAST(0.35 AS DOUBLE) AND complexity > CAST(0.15 AS DOUBLE) AND pixel_count > 50000 THEN 'Photograph'
      WHEN pixel_count > 100000 THEN 'Photograph'
      WHEN complexity < CAST(0.25 AS DOUBLE) AND format = 'PNG' THEN 'TextHeavy'
      ELSE 'Unknown' END AS category,
    list_filter([
      CASE WHEN flat_run_count > 100 THEN 'flat_regions' END,
      CASE WHEN complexity > CAST(0.5 AS DOUBLE) THEN 'high_noise' END,
      CASE WHEN complexity < CAST(0.1 AS DOUBLE) THEN 'smooth' END,
      CASE WHEN complexity > CAST(0.3 AS DOUBLE) AND complexity < CAST(0.5 AS DOUBLE) THEN 'sharp_edges' END,
      CASE WHEN has_alpha THEN 'transparency' END,
      CASE WHEN mean_saturation > CAST(0.6 AS DOUBLE) THEN 'highly_saturated' END,
      CASE WHEN dark_region_ratio > CAST(0.4 AS DOUBLE) THEN 'predominantly_dark' END,
      CASE WHEN flat_region_ratio > CAST(0.3 AS DOUBLE) THEN 'large_flat_areas' END,
      CASE WHEN noise_estimate > CAST(0.3 AS DOUBLE) THEN 'noisy' END,
      CASE WHEN edge_density > CAST(0.15 AS DOUBLE) THEN 'text_or_ui' END
    ], lambda t: t IS NOT NULL) AS characteristics
  FROM profiles1
)"""

REQUESTS = PROFILES + """,
requests AS (
  SELECT *,
    CASE WHEN image_id % 10 = 3 THEN 'JPEG' WHEN image_id % 10 = 7 THEN 'WEBP' WHEN image_id % 50 = 9 THEN 'AVIF' END AS force_format,
    image_id % 13 = 0 AS force_lossless,
    CASE WHEN image_id % 5 = 0 THEN 800 END AS max_width,
    CASE WHEN image_id % 7 = 0 THEN 600 END AS max_height,
    image_id % 6 = 1 AS strip_all_metadata,
    image_id % 8 <> 0 AS preserve_color_profile,
    CASE WHEN image_id % 12 = 0 THEN 5000 END AS time_limit_ms
  FROM profiles
)"""

PIXELS = """
cells AS (
  SELECT vec_id, vec_id // 4 AS image_id, CAST(unnest(embedding) AS DOUBLE) AS v,
    generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings
),
scaled AS (
  SELECT *, CAST(CASE WHEN image_id % 7 = 0 THEN 1200 WHEN image_id % 5 = 0 THEN 60 ELSE 300 END AS DOUBLE) AS gain,
    CAST(CASE WHEN image_id % 5 = 0 THEN 20 ELSE 128 END AS DOUBLE) AS base,
    CAST((vec_id % 2) * 8 + pos % 8 AS INTEGER) AS x, CAST(((vec_id % 4) // 2) * 8 + pos // 8 AS INTEGER) AS y
  FROM cells
),
pixels AS (
  SELECT image_id, x, y,
    CAST(least(greatest(round(base + gain * CAST(1.0 AS DOUBLE) * v), 0), 255) AS INTEGER) AS r,
    CAST(least(greatest(round(base + gain * CAST(0.5 AS DOUBLE) * v), 0), 255) AS INTEGER) AS g,
    CAST(least(greatest(round(base + gain * CAST(-0.5 AS DOUBLE) * v), 0), 255) AS INTEGER) AS b,
    CASE WHEN image_id % 3 = 0 AND x < 4 THEN 128 ELSE 255 END AS a
  FROM scaled
)"""

STRIPS = """
strips AS (
  SELECT l_orderkey AS image_id, CAST(floor(l_quantity * 5) AS INTEGER) AS r,
    CAST(floor(l_discount * 2550) AS INTEGER) AS g, CAST(floor(l_tax * 3187) AS INTEGER) AS b, 255 AS a
  FROM lineitem
)"""

SMALL_PIXELS = """
small_cells AS (
  SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) * 300 AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
),
pixels AS (
  SELECT image_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
    CAST(least(greatest(round(128 + v), 0), 255) AS INTEGER) AS r, CAST(least(greatest(round(128 + v * CAST(0.5 AS DOUBLE)), 0), 255) AS INTEGER) AS g,
    CAST(least(greatest(round(128 - v * CAST(0.5 AS DOUBLE)), 0), 255) AS INTEGER) AS b, CASE WHEN pos % 5 = 0 THEN 128 ELSE 255 END AS a
  FROM small_cells
)"""

IMAGE_FILES = """
image_files AS (
  SELECT i AS image_id, CASE i % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' ELSE 'WEBP' END AS format,
    16 AS width, 16 AS height, 1000 + (i * 7919) % 90000 AS file_size
  FROM (SELECT DISTINCT vec_id // 4 AS i FROM embeddings)
)"""

RUNGS = """
rungs AS (
  SELECT p_partkey AS image_id, CAST(q AS INTEGER) AS q,
    CAST(floor(CAST(20000 AS DOUBLE) * pow(q / CAST(100 AS DOUBLE), CAST(1.7 AS DOUBLE)) + (p_partkey * q) % 700) AS BIGINT) AS size,
    CAST(0.2 AS DOUBLE) + (CAST(100 AS DOUBLE) - q) / (CAST(20 AS DOUBLE) + p_partkey % 37)
      + ((p_partkey * 13 + q) % 9) * CAST(0.05 AS DOUBLE)
      + CASE WHEN p_partkey % 23 = 0 THEN CAST(3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS damage
  FROM part, (SELECT unnest(range(20, 96)) AS q)
)"""

JOB_EVENTS = """
job_events AS (
  SELECT user_id AS job_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Processing' WHEN 'purchase' THEN 'Completed'
      WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Cancelled' END AS status,
    CAST(floor(value * 1000) AS BIGINT) AS original_size,
    CAST(floor(CAST(floor(value * 1000) AS BIGINT) * ((event_id * 37) % 120) / CAST(100 AS DOUBLE)) AS BIGINT) AS final_size,
    (event_id * 53) % 90000 AS processing_time_ms
  FROM events
)"""

LATEST = JOB_EVENTS + """,
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_events)
  WHERE rn = 1
)"""

HISTORY = """
history AS (
  SELECT o_orderkey AS id, o_orderdate AS "timestamp", o_orderpriority AS profile_name, 1 AS files_processed,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS files_failed,
    CAST(floor(o_totalprice * 100) AS BIGINT) AS original_size,
    CAST(floor(CAST(floor(o_totalprice * 100) AS BIGINT) * (30 + o_custkey % 90) / CAST(100 AS DOUBLE)) AS BIGINT) AS output_size,
    (o_custkey * 13) % 60000 AS duration_ms
  FROM orders
)"""

GOAL_REQUESTS = f"""
goal_requests AS (
  SELECT c_custkey AS request_id,
    {texts(PROMPTS)}[1 + c_custkey % 16] AS prompt,
    [NULL, 'png', '.JPG', ' webp ', 'heic', '', 'AVIF'][1 + c_custkey % 7] AS force_format_text
  FROM customer
)"""

PATHS = r"""
paths AS (
  SELECT page_id AS file_id,
    CASE WHEN page_id % 17 = 0 THEN '../' ELSE '' END || regexp_extract(url, '^https?://([^?#]*)', 1) || '/' || page_id
      || ['.png', '.JPG', '.jpeg', '.webp', '.avif', '.gif', '', '.txt', '.tif'][1 + page_id % 9] AS path,
    CAST(length(html) AS BIGINT) AS length,
    ['same_folder', 'output_subfolder', 'custom_folder', 'elsewhere'][1 + page_id % 4] AS output_mode,
    CASE WHEN page_id % 3 <> 0 THEN '/exports' END AS custom_folder,
    page_id % 2 = 0 AS preserve_structure,
    ['', '{name}-small{format}', '{name}{ext}'][1 + page_id % 3] AS template,
    CASE WHEN page_id % 5 = 1 THEN 'webp' END AS target_extension
  FROM pages
)"""

FILE_BLOBS = """
file_blobs AS (
  SELECT doc_id AS file_id,
    'library/' || source || '/file-' || doc_id || '.'
      || ['png', 'jpg', 'WEBP', 'avif', 'gif', 'bmp', 'tif', 'txt', 'jpeg'][1 + doc_id % 9] AS path,
    ['89504E470D0A1A0A', 'FFD8FFE0', '524946461122334457454250', '000000206674797061766966',
     '00000020667479706D696631', '000000206674797071742020', '474946383761', '474946383961', '424D', '49492A00',
     '4D4D002A', '00112233', '89504E47', '524946461122334441564920'][1 + doc_id % 14] || hex(encode(text)) AS content_hex
  FROM documents
)"""

TAGS = """
tags AS (
  SELECT user_id AS image_id, event_id AS pos,
    ['Make', 'Model', 'Software', 'DateTime', 'Orientation', 'GPS', 'DateTimeOriginal', 'DateTimeDigitized', 'PixelXDimension',
     'PixelYDimension', 'ImageWidth', 'ImageLength'][1 + event_id % 12] AS tag,
    CASE WHEN event_id % 12 >= 8 THEN CAST(event_id % 4000 AS VARCHAR) ELSE props END AS value
  FROM events
)"""

LOGS = """
logs AS (
  SELECT event_id AS log_id, ts,
    CASE WHEN event_id % 10 = 0 THEN 'at ' || event_id ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
    CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' THEN 'WARN' ELSE 'INFO' END AS level,
    CASE WHEN user_id % 2 = 0 THEN 'engine' ELSE 'frontend' END AS source, props AS message
  FROM events
)"""


def with_tables(*tables: str) -> str:
    return "WITH " + ",".join(tables)
