"""Oracle SQL for scoring, dominance, decisions and reports."""

from oracles.tables import GOALS, LATEST, MEASUREMENTS, with_tables


def scored(goals: str = GOALS) -> str:
    return MEASUREMENTS + "," + goals + """,
joined AS (
  SELECT m.*, g.* EXCLUDE (goal), lossless OR coalesce(mse = 0, false) AS is_lossless,
    coalesce(lossy_probe_ssim < CAST(0.955 AS DOUBLE), photo_like) AS sensitive, coalesce(quality, 75) AS q0,
    CASE WHEN original_size = 0 THEN CAST(0 AS DOUBLE)
      ELSE CAST(100 AS DOUBLE) * CAST(original_size - output_size AS DOUBLE) / original_size END AS percentage_saved
  FROM measurements m LEFT JOIN goals g USING (goal)
),
parts AS (
  SELECT *,
    least(greatest(ssim, 0), 1) * (CAST(0.85 AS DOUBLE) + CAST(0.15 AS DOUBLE) * least(greatest((psnr - 20) / CAST(30 AS DOUBLE), 0), 1)) AS blended,
    least(greatest(ssim, 0), 1) AS plain,
    CAST(CASE WHEN perceptual > CAST(1.5 AS DOUBLE) THEN 0.9 WHEN perceptual < CAST(0.5 AS DOUBLE) THEN 1.05 ELSE 1.0 END AS DOUBLE) AS nudge,
    CAST(CASE
      WHEN format = 'AVIF' AND sensitive THEN CASE WHEN q0 >= 90 THEN 0.93 WHEN q0 >= 80 THEN 0.85 WHEN q0 >= 70 THEN 0.78
        WHEN q0 >= 60 THEN 0.72 WHEN q0 >= 50 THEN 0.71 WHEN q0 >= 40 THEN 0.70 WHEN q0 >= 30 THEN 0.68 ELSE 0.62 END
      WHEN format = 'AVIF' THEN CASE WHEN q0 >= 80 THEN 0.99 WHEN q0 >= 60 THEN 0.98 WHEN q0 >= 50 THEN 0.97
        WHEN q0 >= 40 THEN 0.95 WHEN q0 >= 30 THEN 0.90 ELSE 0.75 END
      WHEN format = 'WEBP' THEN CASE WHEN q0 >= 90 THEN 0.95 WHEN q0 >= 80 THEN 0.92 WHEN q0 >= 70 THEN 0.88
        WHEN q0 >= 60 THEN 0.84 ELSE 0.78 END
      WHEN format = 'JPEG' THEN CASE WHEN q0 >= 95 THEN 0.96 WHEN q0 >= 85 THEN 0.92 WHEN q0 >= 75 THEN 0.88
        WHEN q0 >= 65 THEN 0.84 ELSE 0.78 END
      ELSE 0.85 END AS DOUBLE) AS guess
  FROM joined
),
qualities AS (
  SELECT *,
    CASE WHEN is_lossless THEN CAST(1 AS DOUBLE) WHEN ssim IS NOT NULL THEN least(blended * nudge, 1) ELSE guess END AS front_quality,
    CASE WHEN is_lossless THEN CAST(1 AS DOUBLE) WHEN ssim IS NOT NULL AND iterative THEN least(plain * nudge, 1)
      WHEN ssim IS NOT NULL THEN least(blended * nudge, 1) ELSE guess END AS quality_score,
    least(greatest(percentage_saved / 100, CAST(-0.5 AS DOUBLE)), 1) AS ratio, percentage_saved / 100 AS s
  FROM parts
),
judged AS (
  SELECT *,
    CASE WHEN NOT success THEN 'backend_error'
      WHEN wq < 0 OR wc < 0 OR ws < 0 OR minq < 0 OR minq > 1 OR wq IS NULL THEN 'invalid_goal'
      WHEN NOT is_lossless AND (CASE WHEN gate THEN coalesce(ssim, quality_score) ELSE quality_score END)
        < (CASE WHEN gate THEN CAST(0.55 AS DOUBLE) WHEN iterative THEN CAST(0.85 AS DOUBLE) ELSE minq END) - CAST(1e-6 AS DOUBLE) THEN 'below_quality'
      WHEN NOT is_lossless AND gate
        AND perceptual > (CASE WHEN iterative THEN CAST(3 AS DOUBLE) ELSE target END) + CAST(1e-9 AS DOUBLE) THEN 'perceptual_limit'
    END AS reason,
    (quality_score * wq
      + (CASE WHEN ratio <= 0 THEN greatest(1 + ratio, 0) * CAST(0.3 AS DOUBLE) ELSE log10(1 + 9 * ratio) END) * wc
      + (CASE WHEN estimated_cost_ms > 0 THEN least(greatest(1 - estimated_cost_ms / CAST(5000 AS DOUBLE), 0), 1) ELSE CAST(1 AS DOUBLE) END) * ws
    ) / (CASE WHEN wq + wc + ws > 0 THEN wq + wc + ws ELSE 1 END)
    + (CASE WHEN list_contains(pref, format)
        THEN CAST(len(pref) - list_position(pref, format) + 1 AS DOUBLE) / len(pref) ELSE CAST(0 AS DOUBLE) END) * wk * CAST(0.05 AS DOUBLE)
    + (CASE WHEN ratio >= CAST(0.8 AS DOUBLE)
        THEN least(greatest((ratio - CAST(0.8 AS DOUBLE)) / CAST(0.2 AS DOUBLE), 0), 1) * CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS raw
  FROM qualities
),
scored AS (
  SELECT *, CASE WHEN reason IN ('backend_error') THEN 'failed' WHEN reason IS NOT NULL THEN 'score' END AS stage,
    CASE WHEN reason IS NULL THEN least(greatest(raw, 0), CAST(1.2 AS DOUBLE)) * (CASE
      WHEN is_lossless THEN CAST(1 AS DOUBLE)
      WHEN s < CAST(0.1 AS DOUBLE) THEN least(greatest(CAST(0.5 AS DOUBLE) + s * 5, CAST(0.5 AS DOUBLE)), 1)
      WHEN s < CAST(0.2 AS DOUBLE) THEN least(greatest(CAST(0.7 AS DOUBLE) + (s - CAST(0.1 AS DOUBLE)) * 3, CAST(0.7 AS DOUBLE)), 1)
      ELSE CAST(1 AS DOUBLE) END) END AS score
  FROM judged
)"""


SCORED = scored()

ANNOTATED = SCORED + """,
accepted AS (SELECT * FROM scored WHERE reason IS NULL),
losers AS (
  SELECT DISTINCT a.image_id, a.goal, a.candidate_id FROM accepted a JOIN accepted b ON a.image_id = b.image_id AND a.goal = b.goal
  WHERE (b.output_size < a.output_size AND b.front_quality >= a.front_quality - CAST(2.220446049250313e-16 AS DOUBLE))
     OR (b.output_size <= a.output_size AND b.front_quality > a.front_quality + CAST(2.220446049250313e-16 AS DOUBLE))
),
annotated AS (
  SELECT s.*, l.candidate_id IS NOT NULL AS dominated, reason IS NULL AND l.candidate_id IS NULL AS survives,
    reason IS NULL AND l.candidate_id IS NULL AND output_size < original_size AS beats
  FROM scored s LEFT JOIN losers l ON s.image_id = l.image_id AND s.goal = l.goal AND s.candidate_id = l.candidate_id
)"""

DECIDED = ANNOTATED + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, goal ORDER BY score DESC, output_size, candidate_id) AS by_score,
    row_number() OVER (PARTITION BY image_id, goal, lossless ORDER BY output_size, score DESC, candidate_id) AS by_size
  FROM annotated WHERE beats
),
best AS (SELECT * FROM ranked WHERE by_score = 1),
small_lossy AS (SELECT * FROM ranked WHERE by_size = 1 AND NOT lossless),
small_lossless AS (SELECT * FROM ranked WHERE by_size = 1 AND lossless),
winners AS (
  SELECT b.image_id, b.goal, b.candidate_id AS best_id,
    CASE WHEN ll.output_size <= ly.output_size THEN ll.candidate_id ELSE b.candidate_id END AS winner_id
  FROM best b LEFT JOIN small_lossy ly ON b.image_id = ly.image_id AND b.goal = ly.goal
  LEFT JOIN small_lossless ll ON b.image_id = ll.image_id AND b.goal = ll.goal
),
images AS (
  SELECT image_id, goal, any_value(original_size) AS original_size, count(*) AS n_candidates,
    count(*) FILTER (WHERE success) AS n_measured, count(*) FILTER (WHERE survives) AS n_survivors
  FROM annotated GROUP BY image_id, goal
),
decided AS (
  SELECT i.*, a.candidate_id, a.format, a.quality, a.lossless, a.iterative, a.score, a.is_lossless, a.ssim, a.psnr, a.output_size,
    CASE WHEN w.winner_id IS NOT NULL THEN 'selected' WHEN n_measured = 0 THEN 'all_failed'
      WHEN n_survivors = 0 THEN 'all_rejected' ELSE 'nothing_smaller' END AS outcome,
    coalesce(w.winner_id <> w.best_id, false) AS preference_fired,
    coalesce(a.output_size, i.original_size) AS final_size, w.winner_id IS NULL AS kept_original
  FROM images i LEFT JOIN winners w USING (image_id, goal)
  LEFT JOIN annotated a ON a.image_id = i.image_id AND a.goal = i.goal AND a.candidate_id = w.winner_id
)"""

CUSTOM_GOALS = """
owned AS (
  SELECT m.* EXCLUDE (goal), 'CUSTOM ' || c_mktsegment AS goal
  FROM measurements m JOIN orders ON o_orderkey = image_id JOIN customer ON c_custkey = o_custkey
),
goals AS (
  SELECT 'CUSTOM ' || c_mktsegment AS goal, round(avg(c_acctbal / CAST(10000 AS DOUBLE)), 4) AS wq, CAST(0.6 AS DOUBLE) AS wc,
    CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN -0.1 ELSE 0.3 END AS DOUBLE) AS ws, CAST(0.4 AS DOUBLE) AS wk,
    CAST(0.7 AS DOUBLE) AS minq, ['JPEG', 'PNG'] AS pref, CAST(1.5 AS DOUBLE) AS target, false AS gate
  FROM customer GROUP BY c_mktsegment
)"""

KEYED = MEASUREMENTS + """,
keyed AS (
  SELECT *, concat_ws('|', format, coalesce(CAST(quality AS VARCHAR), '-'), CAST(lossless AS VARCHAR),
    CASE WHEN format = 'AVIF' THEN CAST(60 + c % 2 AS VARCHAR) ELSE '-' END, CASE WHEN c % 5 = 0 THEN '30000' ELSE '-' END,
    ['keep', 'strip_private', 'strip_all'][1 + c % 3], CAST(c % 4 = 0 AS VARCHAR), CASE WHEN c % 7 = 0 THEN 'fit|800' ELSE '-|-' END, '-') AS encode_key
  FROM (SELECT *, CAST(estimated_cost_ms AS BIGINT) AS c FROM measurements)
)"""

SQL = {
    "decisions_written": with_tables(DECIDED) + " SELECT image_id, goal, outcome, final_size, candidate_id FROM decided",
    "decide": with_tables(DECIDED) + """
SELECT image_id, goal, outcome, kept_original, preference_fired, original_size, final_size, candidate_id, format, quality,
  lossless, round(score, 6) AS score, n_candidates, n_measured, n_survivors
FROM decided""",
    "score_candidates": with_tables(SCORED) + """
SELECT image_id, candidate_id, stage, reason, round(quality_score, 6) AS quality_score,
  round(percentage_saved, 6) AS percentage_saved, round(score, 6) AS score
FROM scored""",
    "pareto_front": with_tables(ANNOTATED) + """
SELECT image_id, candidate_id, output_size, round(front_quality, 6) AS front_quality FROM annotated WHERE survives""",
    "pareto_raw": with_tables(MEASUREMENTS) + """,
m AS (SELECT * FROM measurements WHERE ssim IS NOT NULL)
SELECT image_id, candidate_id, output_size, round(ssim, 6) AS ssim FROM m a
WHERE NOT EXISTS (
  SELECT 1 FROM m b WHERE a.image_id = b.image_id AND (
    (b.output_size < a.output_size AND b.ssim >= a.ssim - CAST(2.220446049250313e-16 AS DOUBLE))
    OR (b.output_size <= a.output_size AND b.ssim > a.ssim + CAST(2.220446049250313e-16 AS DOUBLE))))""",
    "result_metrics": with_tables(MEASUREMENTS) + """,
m AS (
  SELECT *, CAST(100 AS DOUBLE) * CAST(original_size - output_size AS DOUBLE) / original_size AS pct,
    estimated_cost_ms // 1000 AS sec
  FROM measurements WHERE success)
SELECT image_id, candidate_id, greatest(original_size - output_size, 0) AS bytes_saved, round(pct, 6) AS percentage_saved,
  round(output_size / CAST(original_size AS DOUBLE), 6) AS compression_ratio,
  round((original_size / CAST(1048576 AS DOUBLE)) / (estimated_cost_ms / CAST(1000 AS DOUBLE)), 6) AS throughput_mbps,
  CASE WHEN output_size < 1024 THEN output_size || ' B'
    WHEN output_size < 1048576 THEN printf('%.1f KiB', output_size / CAST(1024 AS DOUBLE))
    WHEN output_size < 1073741824 THEN printf('%.1f MiB', output_size / CAST(1048576 AS DOUBLE))
    ELSE printf('%.1f GiB', output_size / CAST(1073741824 AS DOUBLE)) END AS size_text,
  CASE WHEN estimated_cost_ms < 1000 THEN estimated_cost_ms || ' ms'
    WHEN sec >= 3600 THEN (sec // 3600) || ':' || lpad(CAST((sec % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0')
    ELSE (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS duration_text,
  printf('%.1f', round(pct, 1)) || '%' AS percent_text,
  CASE WHEN pct >= 40 THEN 'high' WHEN pct >= 15 THEN 'medium' WHEN pct > 0 THEN 'low' ELSE 'none' END AS band
FROM m""",
    "quality_labels": with_tables(MEASUREMENTS) + """
SELECT lpad(CAST(CAST(round(least(greatest(ssim, 0), 1) * 100) AS INTEGER) AS VARCHAR), 3, '0') AS quality_text, count(*) AS n
FROM measurements WHERE ssim IS NOT NULL GROUP BY 1""",
    "score_custom_goal": "WITH " + scored(CUSTOM_GOALS).replace("FROM measurements m LEFT JOIN goals g USING (goal)", "FROM owned m LEFT JOIN goals g USING (goal)") + """
SELECT image_id, candidate_id, goal, stage, reason, round(score, 6) AS score FROM scored""",
    "runner_up": with_tables(DECIDED) + """
SELECT image_id, candidate_id, output_size, round(score, 6) AS score FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.image_id ORDER BY a.score DESC, a.output_size, a.candidate_id) AS rn
  FROM annotated a JOIN winners w ON a.image_id = w.image_id WHERE a.beats AND a.candidate_id <> w.winner_id)
WHERE rn = 1""",
    "rejections": (with_tables(ANNOTATED) + """
SELECT image_id, candidate_id, CASE WHEN dominated THEN 'front' ELSE stage END AS stage,
  CASE WHEN dominated THEN 'dominated' ELSE reason END AS reason
FROM annotated WHERE NOT survives""").replace(
        "WHEN wq < 0", "WHEN output_size > 3000000 THEN 'output_too_large' WHEN wq < 0"
    ).replace("IN ('backend_error')", "IN ('backend_error', 'output_too_large')"),
    "rejection_rollup": with_tables(ANNOTATED) + """,
rej AS (SELECT goal, format, CASE WHEN dominated THEN 'dominated' ELSE reason END AS reason FROM annotated WHERE NOT survives)
SELECT goal, format, reason, count(*) AS n, 0 AS level FROM rej GROUP BY goal, format, reason
UNION ALL SELECT goal, format, NULL, count(*), 1 FROM rej GROUP BY goal, format
UNION ALL SELECT goal, NULL, NULL, count(*), 2 FROM rej GROUP BY goal
UNION ALL SELECT NULL, NULL, NULL, count(*), 3 FROM rej""",
    "rejection_counts": with_tables(ANNOTATED) + """
SELECT CASE WHEN dominated THEN 'front' ELSE stage END AS stage, CASE WHEN dominated THEN 'dominated' ELSE reason END AS reason,
  count(*) AS n
FROM annotated WHERE NOT survives GROUP BY 1, 2""",
    "batch_totals": with_tables(DECIDED) + """
SELECT count(*) AS total_files, count(*) FILTER (WHERE outcome = 'selected') AS succeeded,
  count(*) FILTER (WHERE outcome = 'all_failed') AS failed,
  count(*) FILTER (WHERE outcome IN ('all_rejected', 'nothing_smaller')) AS kept_original,
  CAST(sum(original_size) AS BIGINT) AS total_original_bytes, CAST(sum(final_size) AS BIGINT) AS total_final_bytes,
  (SELECT CAST(sum(estimated_cost_ms) AS BIGINT) FROM measurements) AS total_processing_ms
FROM decided""",
    "outcome_partition": with_tables(DECIDED) + """
SELECT goal, outcome, count(*) AS images, CAST(sum(original_size) AS BIGINT) AS original_bytes,
  CAST(sum(final_size) AS BIGINT) AS final_bytes
FROM decided GROUP BY goal, outcome""",
    "decision_text": with_tables(DECIDED) + """,
nexts AS (
  SELECT * FROM (
    SELECT a.image_id, a.candidate_id AS next_id, a.score AS next_score,
      row_number() OVER (PARTITION BY a.image_id ORDER BY a.score DESC, a.output_size, a.candidate_id) AS rn
    FROM annotated a JOIN winners w ON a.image_id = w.image_id WHERE a.beats AND a.candidate_id <> w.winner_id)
  WHERE rn = 1)
SELECT d.image_id, CASE
  WHEN outcome = 'selected' THEN concat_ws('; ',
    format || ' ' || candidate_id || ' wins under ' || goal || ' with score ' || printf('%.4f', round(score, 4)),
    final_size || ' of ' || original_size || ' bytes, '
      || printf('%.1f', round(CAST(100 AS DOUBLE) * CAST(original_size - final_size AS DOUBLE) / original_size, 1)) || '% saved',
    CASE WHEN is_lossless THEN 'lossless' WHEN ssim IS NULL THEN 'SSIM null' ELSE 'SSIM ' || printf('%.4f', round(ssim, 4)) END,
    CASE WHEN preference_fired THEN 'lossless preferred at no extra size' END,
    CASE WHEN next_id IS NOT NULL THEN 'next best ' || next_id || ' (' || printf('%.4f', round(next_score, 4)) || ')' END)
  WHEN outcome = 'all_failed' THEN 'original kept: all ' || n_candidates || ' candidates failed'
  WHEN outcome = 'all_rejected' THEN 'original kept: all candidates were rejected'
  ELSE 'original kept: nothing smaller than ' || CASE
    WHEN original_size < 1048576 THEN printf('%.1f KiB', original_size / CAST(1024 AS DOUBLE))
    WHEN original_size < 1073741824 THEN printf('%.1f MiB', original_size / CAST(1048576 AS DOUBLE)) END
  END AS explanation
FROM decided d LEFT JOIN nexts n ON d.image_id = n.image_id""",
    "decision_history": with_tables(DECIDED) + """
SELECT image_id AS id, '2024-01-01T00:00:00Z' AS "timestamp", mode || ':' || goal AS profile_name,
  CASE WHEN kept_original THEN 0 ELSE 1 END AS files_processed, CASE WHEN kept_original THEN 1 ELSE 0 END AS files_failed,
  original_size, final_size AS output_size, n_candidates * 100 AS duration_ms
FROM decided, (VALUES ('auto'), ('queue')) t(mode) WHERE mode = 'auto' OR NOT kept_original""",
    "metric_subset": with_tables(MEASUREMENTS) + """
SELECT image_id, candidate_id, round(ssim, 6) AS ssim FROM measurements
WHERE NOT lossless AND ssim IS NOT NULL AND (goal = 'MAXIMUM'
  OR (ssim >= CAST(0.85 AS DOUBLE) AND ssim <= CAST(0.95 AS DOUBLE) AND perceptual IS NULL))""",
    "encode_reuse": with_tables(KEYED) + """
SELECT image_id, encode_key, min(candidate_id) AS candidate_id, count(*) AS n_candidates FROM keyed GROUP BY image_id, encode_key""",
    "encode_reuse_ratio": with_tables(KEYED) + """,
runs AS (SELECT image_id, encode_key, count(*) AS n FROM keyed GROUP BY image_id, encode_key)
SELECT CAST(sum(n) - count(*) AS BIGINT) AS hits, count(*) AS misses,
  round(CAST(sum(n) - count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS hit_ratio FROM runs""",
    "reused_encodes": with_tables(KEYED) + """,
kept AS (SELECT *, first_value(output_size) OVER (PARTITION BY image_id, encode_key ORDER BY candidate_id) AS shared FROM keyed),
counted AS (
  SELECT count(DISTINCT (image_id, encode_key)) AS every, count(DISTINCT (image_id, encode_key)) FILTER (WHERE image_id % 3 = 0) AS early,
    count(*) AS n, count(*) FILTER (WHERE image_id % 3 = 0) AS n_early, CAST(sum(shared) AS BIGINT) AS b,
    CAST(sum(shared) FILTER (WHERE image_id % 3 = 0) AS BIGINT) AS b_early FROM kept)
SELECT 'first' AS run, CAST(0 AS BIGINT) AS known, early AS measured, n_early AS candidates, b_early AS bytes FROM counted
UNION ALL SELECT 'second', early, every - early, n, b FROM counted""",
    "share_encodes": with_tables(KEYED) + """
SELECT image_id, candidate_id, encode_key,
  first_value(output_size) OVER (PARTITION BY image_id, encode_key ORDER BY candidate_id) AS shared_size FROM keyed""",
    "first_candidates": with_tables(MEASUREMENTS) + """
SELECT image_id, format, quality, lossless, min(candidate_id) AS candidate_id, count(*) AS n_occurrences
FROM measurements GROUP BY ALL""",
    "job_results": with_tables(DECIDED, LATEST) + """
SELECT job_id, status, d.original_size, d.final_size, format AS selected_format,
  CASE WHEN outcome <> 'selected' THEN NULL WHEN lossless THEN 'lossless' WHEN quality IS NULL THEN 'auto' ELSE 'q' || quality END AS selected_quality,
  round(CAST(100 AS DOUBLE) * CAST(d.original_size - d.final_size AS DOUBLE) / d.original_size, 6) AS percentage_saved
FROM latest JOIN decided d ON job_id = image_id""",
}
