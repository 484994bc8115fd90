"""Oracle SQL for profiles, strategies, candidates and targets."""

from oracles.tables import GOALS, PROFILES, REQUESTS, with_tables

RANGES = """
ranges AS (
  SELECT * FROM (VALUES
    ('JPEG','MAXIMUM',NULL,60,82,7), ('JPEG','WEB',NULL,72,88,8), ('JPEG','BALANCED',NULL,78,92,7), ('JPEG','QUALITY',NULL,88,96,4),
    ('JPEG','EXTREME',NULL,65,90,5), ('WEBP','MAXIMUM',NULL,55,80,8), ('WEBP','WEB',NULL,72,88,8), ('WEBP','BALANCED',NULL,78,92,7),
    ('WEBP','QUALITY',NULL,88,96,4), ('WEBP','EXTREME',NULL,60,90,5), ('AVIF','MAXIMUM',true,40,80,10), ('AVIF','MAXIMUM',false,20,60,10),
    ('AVIF','BALANCED',true,80,90,5), ('AVIF','BALANCED',false,50,70,10), ('AVIF','QUALITY',true,90,95,5), ('AVIF','QUALITY',false,65,82,9),
    ('AVIF','EXTREME',true,70,95,8), ('AVIF','EXTREME',false,30,65,8)
  ) t(rformat, rgoal, sens, low, high, step)
)"""

# One row per image, goal and candidate format, in order (fpos from 0).
STRATEGY = REQUESTS + "," + GOALS + "," + RANGES + """,
planned AS (
  SELECT r.*, g.*, coalesce(lossy_probe_ssim < CAST(0.955 AS DOUBLE), category IN ('Photograph','HighlyDetailed','Unknown')) AS photo_sensitive,
    lossy AND NOT force_lossless AS include_lossy
  FROM requests r, goals g
),
possible AS (
  SELECT image_id, goal, 0 AS o, format AS f FROM planned
  UNION ALL
  SELECT image_id, goal, o, f FROM (SELECT image_id, goal, format, is_animated, has_alpha, unnest(pref) AS f, generate_subscripts(pref, 1) AS o FROM planned)
  WHERE f <> format AND NOT (format = 'AVIF' AND f <> 'AVIF') AND NOT (is_animated AND f <> 'GIF') AND NOT (has_alpha AND f IN ('JPEG','BMP'))
),
allowed AS (
  SELECT p.image_id, p.goal, x.o, x.f FROM planned p JOIN possible x USING (image_id, goal)
  WHERE p.force_format IS NULL OR x.f = p.force_format
  UNION ALL
  SELECT image_id, goal, 99 AS o, force_format FROM planned p
  WHERE force_format IS NOT NULL AND force_format <> format
    AND NOT (format = 'AVIF' AND force_format <> 'AVIF') AND NOT (is_animated AND force_format <> 'GIF')
    AND NOT (has_alpha AND force_format IN ('JPEG','BMP'))
    AND NOT EXISTS (SELECT 1 FROM possible x WHERE x.image_id = p.image_id AND x.goal = p.goal AND x.f = p.force_format)
),
formats AS (
  SELECT * FROM (
    SELECT p.*, a.f, row_number() OVER (PARTITION BY p.image_id, p.goal ORDER BY a.o) - 1 AS fpos
    FROM planned p JOIN allowed a USING (image_id, goal) WHERE NOT p.is_animated OR a.f = 'GIF')
  WHERE fpos < greatest(maxc, 1)
),
ranged AS (
  SELECT f.*, CASE WHEN file_size > 52428800 THEN high ELSE low END AS lo, high AS hi,
    CASE WHEN file_size > 52428800 THEN 1 ELSE step END AS st
  FROM formats f LEFT JOIN ranges ON rformat = f.f AND rgoal = goal AND coalesce(sens, photo_sensitive) = photo_sensitive AND include_lossy
)"""

CANDIDATES = STRATEGY + """,
kinds AS (
  SELECT *, searches AND include_lossy AND ((f IN ('JPEG','WEBP') AND NOT has_alpha) OR (f = 'AVIF' AND goal = 'MAXIMUM')) AS searched
  FROM ranged
),
levels AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, goal, f ORDER BY q) AS lpos FROM (
    SELECT DISTINCT * FROM (
      SELECT *, unnest(list_append(range(lo, hi + 1, st), hi)) AS q FROM kinds WHERE lo IS NOT NULL))
),
emitted AS (
  SELECT * EXCLUDE (q, lpos), 'search' AS kind, NULL AS q, false AS ll, 0 AS kpos, 0 AS lpos FROM (SELECT *, 0 AS q, 0 AS lpos FROM kinds) WHERE searched
  UNION ALL
  SELECT * EXCLUDE (q, lpos), 'source', NULL, false, 1, 0 FROM (SELECT *, 0 AS q, 0 AS lpos FROM kinds)
  WHERE NOT searches AND include_lossy AND f = 'JPEG' AND format = 'JPEG'
  UNION ALL
  SELECT * EXCLUDE (q, lpos), 'lossless', NULL, true, 2, 0 FROM (SELECT *, 0 AS q, 0 AS lpos FROM kinds) WHERE f IN ('PNG','WEBP')
  UNION ALL
  SELECT * EXCLUDE (q, lpos), 'level', q, false, 3, lpos FROM levels WHERE NOT searched OR lpos <= 3
),
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, goal ORDER BY fpos, kpos, lpos) - 1 AS position,
    CASE WHEN kind = 'level' AND f = 'AVIF' THEN row_number() OVER (PARTITION BY image_id, goal, f, kind, q // 10 ORDER BY lpos) ELSE 1 END AS in_decade
  FROM emitted
),
judged AS (
  SELECT *, CASE
    WHEN in_decade > 1 THEN 'same_decade'
    WHEN NOT include_lossy AND NOT ll THEN 'goal_no_lossy'
    WHEN file_size < 4096 AND NOT ll THEN 'trivial_file'
    WHEN has_alpha AND f IN ('JPEG','BMP') THEN 'no_alpha_format'
    WHEN is_animated AND f <> 'GIF' THEN 'animated'
    WHEN f = 'PNG' AND NOT ll THEN 'png_lossy'
    WHEN f = 'JPEG' AND ll AND format <> 'JPEG' THEN 'jpeg_lossless_source'
    WHEN pixel_count < 4096 AND NOT ll AND category = 'Icon' THEN 'icon_lossy'
    WHEN category = 'TextHeavy' AND NOT ll AND q < 75 THEN 'text_low_q'
    WHEN category = 'Screenshot' AND f = 'AVIF' AND q < 60 THEN 'screenshot_avif_low_q'
    WHEN list_contains(characteristics, 'predominantly_dark') AND f = 'JPEG' AND q < 80 THEN 'dark_jpeg_low_q'
    WHEN list_contains(characteristics, 'noisy') AND ll AND file_size > 200000 THEN 'noisy_lossless'
    WHEN list_contains(characteristics, 'highly_saturated') AND f = 'JPEG' AND q < 85 THEN 'saturated_jpeg_low_q'
    WHEN list_contains(characteristics, 'large_flat_areas') AND NOT ll AND file_size < 120000 AND q < 80 THEN 'flat_small_low_q'
    WHEN list_contains(characteristics, 'text_or_ui') AND f = 'AVIF' AND q < 70 THEN 'ui_avif_low_q'
    WHEN category = 'Photograph' AND pixel_count > 5000000 AND f = 'PNG' AND ll THEN 'big_photo_png'
    WHEN list_contains(characteristics, 'large_flat_areas') AND f = 'JPEG' AND q < 95 THEN 'flat_jpeg_low_q'
    WHEN pixel_count < 1024 AND NOT ll AND f IN ('AVIF','WEBP','JPEG') THEN 'tiny_lossy' END AS rule
  FROM positioned
),
candidates AS (
  SELECT *, CASE WHEN rule IS NULL AND count(*) FILTER (WHERE rule IS NULL) OVER (PARTITION BY image_id, goal ORDER BY position) > maxc
    THEN 'over_cap' ELSE rule END AS reason,
    least(greatest((CASE WHEN f = 'AVIF' THEN CAST(0.9 AS DOUBLE) WHEN f = 'WEBP' THEN CAST(0.6 AS DOUBLE)
      WHEN f = 'PNG' AND ll AND goal = 'MAXIMUM' THEN CAST(0.85 AS DOUBLE) WHEN f = 'PNG' AND ll THEN CAST(0.5 AS DOUBLE)
      WHEN f = 'JPEG' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END)
      + coalesce(1 - q / CAST(200 AS DOUBLE), CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE), 0), 1) AS effort
  FROM judged
),
costed AS (
  SELECT *, CAST(floor(greatest(greatest(pixel_count / CAST(1000000 AS DOUBLE), CAST(0.01 AS DOUBLE)) * (CASE
      WHEN f = 'AVIF' THEN least(greatest(
          coalesce(CAST(1014 AS DOUBLE) * pow(least(greatest(lossy_probe_bpp, CAST(0.01 AS DOUBLE)), CAST(8 AS DOUBLE)), CAST(0.28 AS DOUBLE))
            * (CASE WHEN has_alpha THEN CAST(2.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) * CAST(1.8 AS DOUBLE), CAST(2000 AS DOUBLE))
          * least(greatest(pow((coalesce(q, 75) + CAST(50 AS DOUBLE)) / CAST(100 AS DOUBLE), CAST(5.8 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(8 AS DOUBLE)),
        CAST(400 AS DOUBLE)), CAST(15000 AS DOUBLE))
      WHEN f = 'WEBP' AND ll THEN CAST(900 AS DOUBLE) WHEN f = 'WEBP' THEN CAST(550 AS DOUBLE)
      WHEN f = 'PNG' AND ll AND effort >= CAST(0.8 AS DOUBLE) THEN CAST(4000 AS DOUBLE)
      WHEN f = 'PNG' THEN CAST(350 AS DOUBLE) WHEN f = 'JPEG' THEN CAST(150 AS DOUBLE) ELSE CAST(500 AS DOUBLE) END)
    * (CASE WHEN f = 'AVIF' THEN CAST(1 AS DOUBLE) ELSE coalesce(CAST(0.9 AS DOUBLE) + (100 - q) / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) END),
    CAST(1 AS DOUBLE))) AS BIGINT) * (CASE WHEN kind = 'search' THEN 6 ELSE 1 END) AS cost
  FROM candidates
)"""

TARGET_FACTORS = """(CASE WHEN noise_estimate > CAST(0.4 AS DOUBLE) THEN CAST(1.3 AS DOUBLE) ELSE 1 END)
  * (CASE WHEN complexity < CAST(0.15 AS DOUBLE) THEN CAST(0.8 AS DOUBLE) ELSE 1 END)
  * (CASE WHEN dark_region_ratio > CAST(0.4 AS DOUBLE) THEN CAST(0.85 AS DOUBLE) ELSE 1 END)
  * (CASE WHEN edge_density > CAST(0.12 AS DOUBLE) THEN CAST(0.75 AS DOUBLE) ELSE 1 END)"""
LABEL = "CASE WHEN kind = 'level' THEN f || ' q' || q ELSE f || ' ' || kind END"
APPLIES = """CASE WHEN f = 'JPEG' THEN CASE WHEN ll THEN false WHEN q IS NULL THEN format = 'JPEG' ELSE NOT has_alpha END
    WHEN f = 'AVIF' THEN format <> 'AVIF' AND NOT ll WHEN f IN ('PNG','WEBP') THEN true ELSE NOT ll END"""

SQL = {
    "classify_images": with_tables(PROFILES) + """
SELECT image_id, category, pixel_count, round(file_size / CAST(greatest(pixel_count, 1) AS DOUBLE), 6) AS bytes_per_pixel,
  file_size > 52428800 AS very_large, category IN ('Photograph','HighlyDetailed','Unknown') AS photo_like,
  round(width / CAST(greatest(height, 1) AS DOUBLE), 6) AS aspect_ratio,
  format || ' ' || width || 'x' || height || ', ' || category || ', complexity ' || printf('%.2f', round(complexity, 2)) AS summary
FROM profiles""",
    "tag_images": with_tables(PROFILES) + " SELECT image_id, unnest(characteristics) AS tag FROM profiles",
    "assign_search_space": with_tables(STRATEGY) + """,
lists AS (
  SELECT image_id, goal, string_agg(f, ',' ORDER BY fpos) AS formats,
    string_agg(CASE WHEN lo IS NOT NULL THEN f || ':' || lo || '-' || hi || '/' || st END, ',' ORDER BY f) AS ranges
  FROM ranged GROUP BY image_id, goal
),
sized AS (
  SELECT *, width / CAST(greatest(height, 1) AS DOUBLE) AS ar,
    coalesce(width > max_width OR height > max_height, coalesce(width > max_width, false) OR coalesce(height > max_height, false))
      AND NOT (force_lossless OR goal = 'LOSSLESS') AS needs
  FROM planned
),
blocked AS (
  SELECT *, CASE WHEN force_format IS NULL OR force_format = format THEN NULL
      WHEN format = 'AVIF' AND force_format <> 'AVIF' THEN 'source_not_decodable' WHEN is_animated AND force_format <> 'GIF' THEN 'animation_lost'
      WHEN has_alpha AND force_format IN ('JPEG','BMP') THEN 'transparency_lost' END AS blocked_reason
  FROM sized
)
SELECT image_id, goal, coalesce(formats, '') AS formats, coalesce(ranges, '') AS ranges, include_lossy, photo_sensitive,
  CASE WHEN strip_all_metadata THEN 'RemoveAll' ELSE meta END AS metadata_mode, preserve_color_profile AND NOT strip_all_metadata AS keep_color_profile,
  CAST(coalesce(time_limit_ms, budget) AS BIGINT) AS time_budget_ms, blocked_reason,
  CASE WHEN NOT needs THEN NULL WHEN max_height IS NULL THEN max_width
    WHEN max_width IS NULL THEN greatest(CAST(width AS BIGINT) * max_height // greatest(height, 1), 1)
    WHEN ar > max_width / CAST(max_height AS DOUBLE) THEN max_width
    ELSE greatest(CAST(round(max_height * ar) AS BIGINT), 1) END AS resize_width,
  CASE WHEN NOT needs THEN NULL WHEN max_height IS NULL THEN greatest(CAST(height AS BIGINT) * max_width // greatest(width, 1), 1)
    WHEN max_width IS NULL THEN max_height
    WHEN ar > max_width / CAST(max_height AS DOUBLE) THEN greatest(CAST(round(max_width / ar) AS BIGINT), 1)
    ELSE max_height END AS resize_height,
  concat_ws('; ', goal || ': ' || format || ' ' || width || 'x' || height, 'content ' || category,
    CASE WHEN is_animated THEN 'animation limits formats to GIF' END, CASE WHEN has_alpha THEN 'transparency must survive' END,
    'formats ' || coalesce(formats, ''), CASE WHEN include_lossy THEN 'lossy allowed' ELSE 'lossless only' END,
    'blocked ' || force_format || ' ' || blocked_reason) AS rationale
FROM blocked LEFT JOIN lists USING (image_id, goal)""",
    "generate_candidates": with_tables(CANDIDATES) + """
SELECT image_id, goal, CAST(position AS INTEGER) AS position, kind, f AS format, CAST(q AS INTEGER) AS quality, ll AS lossless,
  """ + LABEL + """ AS label, reason, """ + APPLIES + """ AS applies,
  round(effort, 6) AS effort, cost AS estimated_cost_ms
FROM costed""",
    "prune_candidates": with_tables(CANDIDATES) + """
SELECT goal, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM candidates WHERE file_size >= 4096 GROUP BY 1, 2""",
    "preset_costs": with_tables(PROFILES) + """
SELECT format, name, mode AS metadata_mode, CASE format WHEN 'JPEG' THEN jq WHEN 'WEBP' THEN wq ELSE aq END AS quality,
  count(*) AS images, CAST(sum(pixel_count) AS BIGINT) AS pixels
FROM profiles, (VALUES ('Web', 'RemoveSafe', 85, 82, 60), ('Lossless', 'Keep', 100, 100, 100), ('Custom', 'RemoveSafe', 85, 82, 60)) t(name, mode, jq, wq, aq)
WHERE format IN ('JPEG', 'WEBP', 'AVIF') GROUP BY ALL""",
    "trivial_files": with_tables(PROFILES) + """
SELECT image_id, file_size AS original_size, file_size AS final_size, 'trivially_small' AS outcome, true AS kept_original
FROM profiles WHERE file_size < 4096""",
    "resize_plan": with_tables(PROFILES) + """,
asked AS (
  SELECT image_id, width, height, width / CAST(height AS DOUBLE) AS ar,
    CASE WHEN image_id % 5 = 0 THEN CAST(12.5 AS DOUBLE) * (image_id % 9) END AS pct,
    CASE WHEN image_id % 4 = 0 THEN 640 END AS tw, CASE WHEN image_id % 6 = 0 THEN 480 END AS th,
    CASE WHEN image_id % 3 = 0 THEN 800 END AS mw, CASE WHEN image_id % 7 = 0 THEN 600 END AS mh,
    CASE WHEN image_id % 2 = 0 THEN 'Fit' WHEN image_id % 3 = 0 THEN 'Fill' ELSE 'Stretch' END AS mode
  FROM profiles
),
scaled AS (
  SELECT *, CASE WHEN pct IS NOT NULL THEN greatest(CAST(round(width * pct / 100) AS BIGINT), 1) ELSE tw END AS w0,
    CASE WHEN pct IS NOT NULL THEN greatest(CAST(round(height * pct / 100) AS BIGINT), 1) ELSE th END AS h0
  FROM asked
),
boxed AS (SELECT *, least(w0, mw) AS w, least(h0, mh) AS h FROM scaled)
SELECT image_id, width, height,
  CASE WHEN w IS NULL AND h IS NULL THEN NULL WHEN h IS NULL THEN w WHEN w IS NULL THEN greatest(width * h // height, 1)
    WHEN mode = 'Fit' AND ar <= w / CAST(h AS DOUBLE) THEN greatest(CAST(round(h * ar) AS BIGINT), 1) ELSE w END AS target_width,
  CASE WHEN w IS NULL AND h IS NULL THEN NULL WHEN h IS NULL THEN greatest(height * w // width, 1) WHEN w IS NULL THEN h
    WHEN mode = 'Fit' AND ar > w / CAST(h AS DOUBLE) THEN greatest(CAST(round(w / ar) AS BIGINT), 1) ELSE h END AS target_height
FROM boxed""",
    "adaptive_target": with_tables(PROFILES, GOALS) + """
SELECT image_id, goal, round(CASE WHEN target = 0 THEN CAST(0 AS DOUBLE) ELSE least(greatest(target
  * """ + TARGET_FACTORS + """, CAST(0.5 AS DOUBLE)), CAST(3 AS DOUBLE)) END, 6) AS target
FROM profiles, goals""",
    "format_catalog": with_tables(PROFILES) + """,
catalog AS (
  SELECT * FROM (VALUES ('PNG', 0, 'png', true, true, true, true), ('JPEG', 1, 'jpg,jpeg', true, true, true, true),
    ('WEBP', 2, 'webp', true, true, true, true), ('AVIF', 3, 'avif', false, true, false, true), ('GIF', 4, 'gif', true, true, false, true),
    ('BMP', 5, 'bmp', true, true, false, true), ('TIFF', 6, 'tif,tiff', true, true, false, true)
  ) t(format, code, extensions, can_read, can_write, can_optimize, can_convert))
SELECT c.*, count(p.image_id) AS images, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes
FROM catalog c LEFT JOIN profiles p USING (format) GROUP BY ALL""",
}
