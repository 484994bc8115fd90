"""SQL twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from sizewise.llm.mixing import PART_MEAN, PART_MOST, SEED

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
cut AS (
  SELECT item_id, least(len(words), 10) AS n, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
  FROM items WHERE len(words) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM cut),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM docs, lens WHERE len(words) >= n),
hits AS (
  SELECT s.doc_id, s.n, s.i, w.item_id
  FROM (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w FROM spots) s JOIN wins w USING (n, w)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

LINE_DEDUP = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM split WHERE len(lines) >= 3),
wins AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS w FROM spots),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM wins),
marked AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM ranked WHERE r > 1),
every AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS p, lines FROM split),
kept AS (
  SELECT e.doc_id, string_agg(e.lines[e.p], chr(10) ORDER BY e.p) AS cut, count(*) AS n
  FROM every e ANTI JOIN marked m ON e.doc_id = m.doc_id AND e.p = m.p GROUP BY e.doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.cut, '') END AS text,
       CAST(coalesce(len(s.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(s.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM split s LEFT JOIN kept k USING (doc_id)
"""

MIX_SOURCES = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST((SELECT sum(n) FROM counts) AS DOUBLE) * (1.0::DOUBLE / (SELECT count(*) FROM counts)) / n AS rate
  FROM counts),
parts AS (
  SELECT source, CAST(ceil(rate / {PART_MEAN}) AS BIGINT) AS parts, rate / CAST(ceil(rate / {PART_MEAN}) AS BIGINT) AS mean
  FROM rates),
steps AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM parts
  UNION ALL
  SELECT source, parts, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1)
  FROM steps WHERE k + 1 < {PART_MOST}),
drawn AS (
  SELECT d.*, p.part, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || p.part), 1, 13)
         AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN (SELECT source, unnest(range(0, parts)) AS part FROM parts) p
    ON d.source IS NOT DISTINCT FROM p.source),
times AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.part, count(s.k) AS times
  FROM drawn d LEFT JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= d.u
  GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars, d.part),
copies AS (SELECT *, part * {PART_MOST} + unnest(range(1, times + 1)) AS copy FROM times)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy,
       CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 15) AS BIGINT)
         AS shuffle_key
FROM copies
"""

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
URL_RULES = rf"""
WITH given(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.r, g.host || g.path AS rule, g.verdict,
         row_number() OVER (PARTITION BY p.r ORDER BY length(g.host || g.path) DESC, length(g.host) DESC) AS best
  FROM parts p JOIN given g
    ON (p.host = g.host OR ends_with(p.host, '.' || g.host)) AND starts_with(p.path, g.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.r = p.r AND f.best = 1
"""

# Counts of all n-grams of up to four words, the cheapest cut of each phrase, and what lies inside longer phrases.
PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS m FROM spots)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS a_longer
  FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i
        FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates WHERE m > 2)) GROUP BY 1, 2),
left_over AS (
  SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase
  WHERE s.a_longer IS NULL OR CAST(100 AS HUGEINT) * s.a_longer < CAST(80 AS HUGEINT) * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

# The checksum is computed byte by byte; letters above ASCII are two bytes in UTF-8.
SPELLINGS = rf"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents),
each_run AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
bytes AS (
  SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
         CASE WHEN ascii(c) < 128 THEN [ascii(c)] ELSE [192 + (ascii(c) >> 6), 128 + (ascii(c) & 63)] END)) AS b FROM each_run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
         lambda c, v: xor(c >> 8, crc[CAST(xor(c, v) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM bytes, crcs),
written AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
         ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
skips AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION
  SELECT s.word, w.word, w.n FROM skips s JOIN words w ON w.word = s.p || s.s
  UNION
  SELECT w.word, s.word, s.n FROM skips s JOIN words w ON w.word = s.p || s.s),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m,
         row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS o FROM near),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.o = 1),
steps AS (
  SELECT word, word AS at FROM told
  UNION ALL
  SELECT s.word, t.form FROM steps s JOIN told t ON t.word = s.at WHERE t.form IS NOT NULL),
roots AS (SELECT s.word, s.at AS root FROM steps s JOIN told t ON t.word = s.at WHERE t.form IS NULL)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n FROM told t JOIN roots r ON r.word = t.word
"""

ORACLES = {
    "op5_decontaminate": DECONTAMINATE,
    "op6_line_dedup": LINE_DEDUP,
    "op7_mix_sources": MIX_SOURCES,
    "op10_url_rules": URL_RULES,
    "op11_phrases": PHRASES,
    "op12_spelling_variants": SPELLINGS,
}
