"""DuckDB SQL for the training-data queries that SQL can express."""

from .licenses import ANCHORS, AROUND, LEAST, MARKS, SPDX, SPDX_TAG, TEMPLATES, TERM

OP8 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
lines AS (
  SELECT doc_id, host, pos, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
digests AS (SELECT doc_id, host, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM lines WHERE line <> '' GROUP BY 1, 2),
held AS (
  SELECT doc_id, host, line, count(*) * (length(line) - length(replace(line, ' ', '')) + 1) AS words FROM lines WHERE line <> '' GROUP BY 1, 2, 3),
hosts AS (SELECT host, count(DISTINCT digest) AS host_docs FROM digests GROUP BY 1),
frequent AS (
  SELECT host, line FROM held JOIN digests USING (doc_id, host) JOIN hosts USING (host)
  GROUP BY host, line, host_docs HAVING count(DISTINCT digest) > 4 AND count(DISTINCT digest) > 0.01 * host_docs),
gone AS (SELECT doc_id, sum(words) AS n FROM held JOIN frequent USING (host, line) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(gone.n, 0) <= 0.5 * n_words AS kept
FROM base LEFT JOIN gone USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))

_SPDX_ROWS = ", ".join(f"('{name.lower()}', '{name}')" for name in SPDX)

OP9 = rf"""
WITH f AS (
  SELECT doc_id, text, CASE
    WHEN doc_id % 10000 = 0 THEN coalesce(source, 'unknown') || '/LICENSE'
    WHEN doc_id % 1000 = 0 THEN coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/LICENSE'
    WHEN doc_id % 100 = 0 THEN coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/' || doc_id // 100 % 10 || '/LICENSE'
    ELSE coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/' || doc_id // 100 % 10 || '/f' || doc_id END AS path
  FROM documents),
t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS v(template, name, body)),
tt AS (SELECT template, name, term, count(*) AS n FROM (SELECT template, name, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY 1),
tw AS (SELECT template, name, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS w FROM tt JOIN idf USING (term)),
low AS (
  SELECT doc_id, path, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{MARKS}', '', 'g') AS text FROM f),
par AS (
  SELECT doc_id, replace(body, chr(10), ' ') AS body FROM (SELECT doc_id, unnest(string_split_regex(text, '\n\n+')) AS body FROM low) WHERE regexp_matches(body, '{ANCHORS}')),
sen AS (SELECT * FROM (SELECT doc_id, unnest(string_split_regex(body, '[.!?] +')) AS body FROM par) WHERE regexp_matches(body, '{ANCHORS}')),
b AS (
  SELECT doc_id, row_number() OVER () AS block, body FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM low
    UNION SELECT doc_id, body FROM par
    UNION SELECT doc_id, body FROM sen
    UNION SELECT doc_id, unnest(regexp_extract_all(body, '{AROUND}')) FROM sen
    UNION SELECT doc_id, text FROM low WHERE path LIKE '%/LICENSE')
  WHERE regexp_matches(body, '{ANCHORS}')),
ids AS (SELECT * FROM (VALUES {_SPDX_ROWS}) AS v(id, name)),
tagged AS (SELECT doc_id, name, 1.0 AS score FROM low JOIN ids ON id = regexp_extract(text, '{SPDX_TAG}', 1)),
x AS (
  SELECT doc_id, block, term, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM t)) + 1) AS x
  FROM (SELECT doc_id, block, term, count(*) AS tf FROM (SELECT doc_id, block, unnest(regexp_extract_all(body, '{TERM}')) AS term FROM b) GROUP BY ALL)
  LEFT JOIN idf USING (term)),
norm AS (SELECT block, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1),
s AS (
  SELECT doc_id, name, max(score) AS score FROM (
    SELECT doc_id, name, score FROM (SELECT doc_id, block, template, name, round(sum(x * w) / any_value(norm), 6) AS score FROM x JOIN tw USING (term) JOIN norm USING (block) GROUP BY ALL)
    UNION ALL SELECT * FROM tagged)
  GROUP BY ALL HAVING max(score) >= {LEAST}),
own AS (SELECT doc_id, min(name) AS own_license, max(score) AS own_score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s) WHERE score = top GROUP BY 1),
dirs AS (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM f LEFT JOIN own USING (doc_id)),
granted AS (SELECT dir, arg_min(own_license, row(-own_score, path)) AS license FROM dirs WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY 1),
near AS (
  SELECT d.dir, arg_max(row(g.license, g.dir), length(g.dir)) AS g
  FROM (SELECT DISTINCT dir FROM dirs) d JOIN granted g ON d.dir = g.dir OR starts_with(d.dir, g.dir || '/') GROUP BY 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, g[1]) AS license, CASE WHEN own_license IS NULL THEN g[2] END AS license_from
FROM dirs LEFT JOIN near USING (dir)
"""

ORACLE_SQL = {"op9_license_scans": OP9, "op8_exact_dedup": OP8, "op10_quality_rules": OP10}
