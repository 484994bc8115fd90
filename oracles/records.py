"""Oracle SQL for jobs, history, requests, paths, content and metadata."""

from oracles.tables import (
    FILE_BLOBS, GOAL_REQUESTS, GOALS, HISTORY, JOB_EVENTS, LATEST, LOGS, PATHS, TAGS, with_tables,
)
from sizewise.functions import goals
from sizewise.functions.paths import HEIF_BRANDS

BRANDS = ", ".join(f"'{b.encode().hex().upper()}'" for b in HEIF_BRANDS)

STATS = LATEST + """,
stats AS (
  SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'Queued') AS queued, count(*) FILTER (WHERE status = 'Processing') AS processing,
    count(*) FILTER (WHERE status = 'Completed') AS completed, count(*) FILTER (WHERE status = 'Failed') AS failed,
    count(*) FILTER (WHERE status = 'Cancelled') AS cancelled, count(*) FILTER (WHERE status = 'Skipped') AS skipped,
    CAST(coalesce(sum(original_size) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS original_bytes,
    CAST(coalesce(sum(final_size) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS final_bytes,
    CAST(coalesce(sum(processing_time_ms) FILTER (WHERE status = 'Completed'), 0) AS BIGINT) AS total_processing_ms
  FROM latest
)"""

LATEST_SQL = with_tables(LATEST) + """
SELECT job_id, event_id, status, original_size, final_size, processing_time_ms FROM latest"""
ALERTS_SQL = with_tables(JOB_EVENTS) + """
SELECT job_id, event_id FROM (
  SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM job_events
  WHERE status IN ('Failed', 'Completed', 'Cancelled'))
WHERE status = 'Failed' AND coalesce(before, '') <> 'Failed'"""
OUTCOME_SQL = with_tables(JOB_EVENTS) + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM job_events),
starts AS (SELECT job_id, coalesce(max(i) FILTER (WHERE status = 'Queued'), 0) AS start FROM ordered GROUP BY job_id),
live AS (SELECT o.* FROM ordered o JOIN starts USING (job_id) WHERE i >= start)
SELECT job_id, coalesce(arg_min(status, i) FILTER (WHERE status IN ('Completed', 'Failed', 'Cancelled')), arg_max(status, i)) AS status
FROM live GROUP BY job_id"""
STATS_SQL = with_tables(STATS) + " SELECT * FROM stats"


def units(v: str) -> str:
    return f"""CASE WHEN {v} < 1024 THEN {v} || ' B' WHEN {v} < 1048576 THEN printf('%.1f KiB', {v} / CAST(1024 AS DOUBLE))
    WHEN {v} < 1073741824 THEN printf('%.1f MiB', {v} / CAST(1048576 AS DOUBLE)) ELSE printf('%.1f GiB', {v} / CAST(1073741824 AS DOUBLE)) END"""


def has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(plain, '{w}')" for w in words) + ")"


SIGNALS = " + ".join(f"CAST(contains(plain, '{w}') AS INTEGER)" for w in goals.LIGHT_SIGNALS + goals.QUALITY_SIGNALS)


def goal(text: str, identifiers: bool) -> str:
    """Decision tree of the free-text goal over a column ``plain``."""
    exact = f"""WHEN {text} IN ('Lossless') THEN 'LOSSLESS' WHEN {text} = 'Quality' THEN 'QUALITY' WHEN {text} = 'Balanced' THEN 'BALANCED'
    WHEN {text} IN ('Compress', 'MaximumCompression') THEN 'MAXIMUM' WHEN {text} = 'Web' THEN 'WEB' WHEN {text} = 'ExtremeLightweight' THEN 'EXTREME'"""
    light, quality, lossless = has(goals.LIGHT_SIGNALS), has(goals.QUALITY_SIGNALS), has(goals.LOSSLESS_SIGNALS)
    speed, balance = has(goals.SPEED_SIGNALS), has(goals.BALANCE_SIGNALS)
    return f"""CASE {exact if identifiers else ''} WHEN trim(plain) = '' THEN 'BALANCED' WHEN {balance} THEN 'BALANCED' WHEN {lossless} THEN 'LOSSLESS'
    WHEN {quality} AND ({light} OR {has(goals.EXTREME_WORDS)}) THEN 'EXTREME' WHEN {light} THEN 'MAXIMUM' WHEN {quality} THEN 'QUALITY'
    WHEN {speed} THEN 'WEB' ELSE 'BALANCED' END"""


PLAIN = f"translate(lower({{}}), '{goals.ACCENTED}', '{goals.PLAIN}')".format

PATH_PARTS = PATHS + r""",
named AS (
  SELECT *, regexp_extract(path, '([^/]*)$', 1) AS fname, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM paths
),
parts AS (
  SELECT *, regexp_extract(fname, '^.+\.([^.]*)$', 1) AS ext,
    CASE WHEN regexp_matches(fname, '^.+\.[^.]*$') THEN regexp_extract(fname, '^(.+)\.[^.]*$', 1) ELSE fname END AS stem
  FROM named
),
outs AS (
  SELECT *, replace(replace(replace(CASE WHEN template = '' THEN '{name}_optimized{format}' ELSE template END, '{name}', stem), '{ext}', '.' || ext),
      '{format}', '.' || coalesce(target_extension, ext)) AS oname,
    CASE WHEN output_mode = 'output_subfolder' THEN folder || '/optimized'
      WHEN output_mode = 'custom_folder' AND custom_folder IS NOT NULL AND preserve_structure THEN custom_folder || '/' || regexp_extract(folder, '([^/]*)$', 1)
      WHEN output_mode = 'custom_folder' AND custom_folder IS NOT NULL THEN custom_folder ELSE folder END AS ofolder
  FROM parts
),
dests AS (SELECT *, ofolder || '/' || oname AS destination FROM outs)"""

ISSUE = """CASE WHEN path = '' THEN 'EmptyPath' WHEN list_contains(string_split(path, '/'), '..') THEN 'PathTraversal'
  WHEN lower(ext) NOT IN ('png','jpg','jpeg','webp','avif','gif','bmp','tif','tiff') THEN 'UnsupportedExtension'"""


def format_of(ext: str) -> str:
    return f"""CASE WHEN lower({ext}) = 'png' THEN 'PNG' WHEN lower({ext}) IN ('jpg','jpeg') THEN 'JPEG' WHEN lower({ext}) = 'webp' THEN 'WEBP'
    WHEN lower({ext}) = 'avif' THEN 'AVIF' WHEN lower({ext}) = 'gif' THEN 'GIF' WHEN lower({ext}) = 'bmp' THEN 'BMP'
    WHEN lower({ext}) IN ('tif','tiff') THEN 'TIFF' ELSE 'UNKNOWN' END"""


SNIFFED = FILE_BLOBS + rf""",
sniffed AS (
  SELECT *, CASE WHEN h LIKE '89504E470D0A1A0A%' THEN 'PNG' WHEN h LIKE 'FFD8FF%' THEN 'JPEG'
    WHEN h LIKE '52494646________57454250%' THEN 'WEBP'
    WHEN h LIKE '________66747970%' AND substr(h, 17, 8) IN ({BRANDS}) THEN 'AVIF'
    WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'GIF' WHEN h LIKE '424D%' THEN 'BMP'
    WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'TIFF' ELSE 'UNKNOWN' END AS real_format,
    regexp_extract(path, '\.([^.]*)$', 1) AS ext
  FROM (SELECT *, substr(content_hex, 1, 24) AS h FROM file_blobs)
)"""

AUDIT = TAGS + """,
read_tags AS (
  SELECT image_id, true AS has_exif, bool_or(tag = 'GPS') AS has_gps, arg_max(value, pos) FILTER (WHERE tag = 'Make') AS camera_make,
    arg_max(value, pos) FILTER (WHERE tag = 'Model') AS camera_model, arg_max(value, pos) FILTER (WHERE tag = 'Software') AS software,
    arg_min(value, pos) FILTER (WHERE tag LIKE 'DateTime%') AS first_datetime,
    arg_max(value, pos) FILTER (WHERE tag = 'Orientation') AS orientation,
    arg_max(TRY_CAST(value AS INTEGER), pos) FILTER (WHERE tag IN ('PixelXDimension', 'ImageWidth') AND TRY_CAST(value AS INTEGER) IS NOT NULL) AS exif_width,
    arg_max(TRY_CAST(value AS INTEGER), pos) FILTER (WHERE tag IN ('PixelYDimension', 'ImageLength') AND TRY_CAST(value AS INTEGER) IS NOT NULL) AS exif_height
  FROM tags GROUP BY image_id
),
audit AS (
  SELECT c_custkey AS image_id, ['JPEG', 'TIFF', 'PNG'][1 + c_custkey % 3] AS format, coalesce(has_exif, false) AS has_exif,
    coalesce(has_gps, false) AS has_gps, camera_make, camera_model, software, first_datetime, orientation, exif_width, exif_height
  FROM customer LEFT JOIN read_tags ON image_id = c_custkey
)"""

SQL = {
    "latest_job_status": LATEST_SQL,
    "stream_latest_status": LATEST_SQL,
    "queue_stats": STATS_SQL,
    "stream_queue_stats": STATS_SQL,
    "live_stats": with_tables(STATS) + """
SELECT completed AS files_processed, failed AS files_failed, queued AS files_queued, processing AS files_processing,
  original_bytes AS bytes_in, final_bytes AS bytes_out, total_processing_ms, original_bytes - final_bytes AS space_saved_bytes,
  CASE WHEN original_bytes = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * CAST(original_bytes - final_bytes AS DOUBLE) / original_bytes, 6) END AS compression_percentage,
  CASE WHEN total_processing_ms = 0 THEN CAST(0 AS DOUBLE) ELSE round(completed / (total_processing_ms / CAST(1000 AS DOUBLE)), 6) END AS files_per_second
FROM stats""",
    "batch_summary": with_tables(STATS) + f""",
v AS (SELECT *, original_bytes - final_bytes AS saved, total_processing_ms // 1000 AS sec,
  CAST(100 AS DOUBLE) * CAST(original_bytes - final_bytes AS DOUBLE) / original_bytes AS pct FROM stats)
SELECT completed || ' files, ' || {units('original_bytes')} || ' -> ' || {units('final_bytes')} || ', '
  || CASE WHEN saved < 0 THEN 'grew by ' ELSE 'saved ' END || {units('abs(saved)')} || ' (' || printf('%.1f', round(pct, 1)) || '%), '
  || CASE WHEN total_processing_ms < 1000 THEN total_processing_ms || ' ms'
    WHEN sec >= 3600 THEN (sec // 3600) || ':' || lpad(CAST((sec % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0')
    ELSE (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS summary
FROM v""",
    "job_alerts": ALERTS_SQL,
    "stream_alerts": ALERTS_SQL,
    "job_outcome": OUTCOME_SQL,
    "stream_outcomes": OUTCOME_SQL,
    "retry_jobs": with_tables(LATEST) + """
SELECT job_id, CAST(CASE WHEN job_id % 4 <> 0 THEN job_id % 3 + 1 ELSE 1 END + CASE WHEN status IN ('Failed','Cancelled') THEN 1 ELSE 0 END AS INTEGER) AS attempt,
  CASE WHEN status IN ('Failed','Cancelled') THEN 'Queued' ELSE status END AS status,
  CASE WHEN status IN ('Failed','Cancelled') THEN 0 ELSE original_size END AS original_size,
  CASE WHEN status IN ('Failed','Cancelled') THEN 0 ELSE final_size END AS final_size,
  CASE WHEN status IN ('Failed','Cancelled') THEN 0 ELSE processing_time_ms END AS processing_time_ms
FROM latest""",
    "clear_jobs": with_tables(LATEST) + """
SELECT job_id, status FROM latest WHERE status NOT IN ('Completed','Failed','Cancelled','Skipped')""",
    "recent_jobs": with_tables(LATEST) + " SELECT job_id, status, final_size FROM latest ORDER BY job_id DESC LIMIT 8",
    "history_latest": with_tables(HISTORY) + """
SELECT id, profile_name, files_failed, original_size, output_size FROM history ORDER BY "timestamp" DESC, id DESC LIMIT 1000""",
    "history_totals": with_tables(HISTORY) + """
SELECT count(*) AS total_runs, CAST(sum(files_processed) AS BIGINT) AS total_files_processed, CAST(sum(files_failed) AS BIGINT) AS total_files_failed,
  CAST(sum(original_size) AS BIGINT) AS total_original_bytes, CAST(sum(output_size) AS BIGINT) AS total_output_bytes,
  CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms
FROM history""",
    "recent_logs": with_tables(LOGS) + """
SELECT log_id, (CASE WHEN "timestamp" LIKE 'at %' THEN "timestamp" ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END)
  || ' [' || level || '] [' || source || '] ' || message AS line
FROM logs ORDER BY ts DESC, log_id DESC LIMIT 5000""",
    "history_kept": with_tables(HISTORY) + """
SELECT id, profile_name, files_failed, original_size, output_size, duration_ms FROM history WHERE id % 5 <> 0 ORDER BY "timestamp" DESC, id DESC LIMIT 500""",
    "catalogues_read": """
WITH p AS (
  SELECT s_suppkey AS k, unnest([0, 1, 2]) AS i FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT 'p' || i || '-' || k AS name, kind, CAST(50 + (k * 7 + i) % 50 AS INTEGER) AS jpeg_quality,
  i = 1 AND k % 3 = 0 AS is_default
FROM (SELECT *, ['Web', 'Lossless', 'Custom', 'Other'][1 + (k + i) % 4] AS kind FROM p) WHERE kind <> 'Other'""",
    "logs_exported": with_tables(LOGS) + """
SELECT line, length(line) AS n_chars FROM (SELECT (CASE WHEN "timestamp" LIKE 'at %' THEN "timestamp" ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END)
  || ' [' || level || '] [' || source || '] ' || message AS line FROM logs)""",
    "jobs_by_id": with_tables(LATEST) + " SELECT job_id, status, original_size, final_size FROM latest",
    "stream_recent_logs": with_tables(LOGS) + " SELECT log_id, level, message FROM logs ORDER BY ts DESC, log_id DESC LIMIT 5000",
    "stream_arrivals": with_tables(PATH_PARTS) + f"""
SELECT path AS source, folder || '/' || stem || '_optimized.' || ext AS destination, {format_of('ext')} AS input_format, 'Queued' AS status,
  'QUALITY' AS goal
FROM parts WHERE ({ISSUE} ELSE 'Ok' END) = 'Ok'""",
    "goal_from_text": with_tables(GOAL_REQUESTS, GOALS) + f""",
decided AS (SELECT request_id, {goal('prompt', True)} AS goal, lower(ltrim(trim(force_format_text), '.')) AS ff
  FROM (SELECT *, {PLAIN('prompt')} AS plain FROM goal_requests))
SELECT request_id, goal, CASE WHEN ff IN ('jpg','jpeg') THEN 'JPEG' WHEN ff IN ('tif','tiff') THEN 'TIFF'
  WHEN ff IN ('png','webp','avif','gif','bmp') THEN upper(ff) END AS force_format, maxc AS max_candidates, array_to_string(pref, ',') AS preferred
FROM decided JOIN goals USING (goal)""",
    "goals_in_documents": f"""
SELECT source, {goal('text', False)} AS goal, CAST(coalesce({SIGNALS}, 0) AS INTEGER) AS signals, count(*) AS n
FROM (SELECT source, text, {PLAIN('text')} AS plain FROM (
  SELECT source, text FROM documents UNION ALL SELECT 'turn of ' || role, text FROM conversations)) GROUP BY 1, 2, 3""",
    "validate_paths": with_tables(PATH_PARTS) + f"""
SELECT file_id, {ISSUE} WHEN length > 4000 THEN 'TooLarge' ELSE 'Ok' END AS issue FROM parts""",
    "output_paths": with_tables(PATH_PARTS) + rf""",
final AS (
  SELECT *, regexp_extract(destination, '([^/]*)$', 1) AS dname,
    CASE file_id % 3 WHEN 0 THEN 'WEBP' WHEN 1 THEN 'JPEG' END AS picked FROM dests
),
split AS (
  SELECT *, regexp_extract(dname, '^.+\.([^.]*)$', 1) AS dext,
    CASE WHEN regexp_matches(dname, '^.+\.[^.]*$') THEN regexp_extract(dname, '^(.+)\.[^.]*$', 1) ELSE dname END AS dstem FROM final
)
SELECT file_id, destination, dname AS name, CASE WHEN picked IS NULL OR {format_of('dext')} = picked THEN destination
  ELSE ofolder || '/' || dstem || CASE picked WHEN 'WEBP' THEN '.webp' ELSE '.jpg' END END AS final_path
FROM split""",
    "enqueue_jobs": with_tables(PATH_PARTS) + f""",
issues AS (
  SELECT *, {ISSUE} WHEN destination = path THEN 'SameFile' END AS issue FROM dests)
SELECT file_id, path AS source, CASE WHEN issue IS NULL THEN destination END AS destination,
  CASE WHEN issue IS NULL THEN {format_of('ext')} END AS input_format, CASE WHEN issue IS NULL THEN 'Queued' END AS status,
  CASE WHEN issue IS NULL THEN ['LOSSLESS', 'QUALITY', 'MAXIMUM', 'EXTREME', 'QUALITY'][1 + file_id % 5] END AS goal, issue
FROM issues""",
    "sniff_formats": with_tables(SNIFFED) + " SELECT file_id, real_format FROM sniffed",
    "extension_audit": with_tables(SNIFFED) + f""",
a AS (SELECT *, {format_of('ext')} AS ext_format FROM sniffed)
SELECT file_id, ext_format, real_format, ext_format = real_format AND real_format <> 'UNKNOWN' AS matches,
  CASE WHEN real_format <> 'UNKNOWN' AND ext_format <> real_format THEN substr(path, 1, length(path) - length(ext))
    || CASE real_format WHEN 'JPEG' THEN 'jpg' WHEN 'TIFF' THEN 'tif' ELSE lower(real_format) END END AS renamed_path
FROM a""",
    "metadata_audit": with_tables(AUDIT) + " SELECT * FROM audit",
    "metadata_fleet": with_tables(AUDIT) + """
SELECT format, count(*) AS images, count(*) FILTER (WHERE has_exif) AS with_exif, count(*) FILTER (WHERE has_gps) AS with_gps,
  count(*) FILTER (WHERE camera_make IS NOT NULL) AS with_make
FROM audit GROUP BY format""",
}
