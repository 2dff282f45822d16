"""DuckDB statements of the operators that fill a module of their own."""

from __future__ import annotations


def _rounds(number: int) -> str:
    """Assignments and centroids of every round, as one statement cannot loop."""
    parts = []
    for r in range(number + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, arg_min(k, (distance, k)) AS k, min(distance) AS distance FROM (
    SELECT w.rid, c.k, CAST(sum((w.x - c.x) * (w.x - c.x)) AS BIGINT) AS distance
    FROM whole w JOIN centre{r} c USING (d) GROUP BY w.rid, c.k) GROUP BY rid
)""")
        if r < number:
            parts.append(f"""
centre{r + 1} AS MATERIALIZED (
  SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM centre{r} c LEFT JOIN (
    SELECT n.k, w.d, CAST((sum(w.x) - ((sum(w.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM near{r} n JOIN whole w USING (rid) GROUP BY n.k, w.d) m USING (k, d)
)""")
    return ",".join(parts)


CENTROIDS = f"""
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
whole AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, unnest(x) AS x FROM usable),
chosen AS MATERIALIZED (
  SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k FROM usable
  QUALIFY k < 8
),
centre0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS d, unnest(x) AS x FROM chosen),{_rounds(10)},
shas AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centre10 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near10 JOIN usable USING (rid) JOIN shas USING (k)"""

DIVERGENCE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t
  FROM documents
),
found AS MATERIALIZED (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(t, '[A-Za-z\x{80}-\x{10FFFF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
),
kept AS MATERIALIZED (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
seen AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM seen GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY lang) USING (lang)
),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(s.n, 0) + 2)::HUGEINT) // (total + 2 * terms) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
),
q AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (max(total) + 2 * max(terms)) AS BIGINT) AS q
  FROM seen JOIN (SELECT lang, sum(total) AS total, max(terms) AS terms FROM groups GROUP BY lang) USING (lang)
  GROUP BY lang, term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
) WHERE part = 'pair' OR rank <= 10"""

SUFFIXES = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
-- Rows with one doc_id and text are one document; different texts of one doc_id follow by hash.
texts AS MATERIALIZED (
  SELECT h, doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(h)) AS tid FROM (SELECT DISTINCT h, doc_id FROM d)
),
strings AS MATERIALIZED (
  SELECT tid, i, md5_number(substr(h, 2 * i + 1, 200)) AS s
  FROM (SELECT tid, h, unnest(range(length(h) // 2 - 99)) AS i FROM texts WHERE length(h) >= 200)
),
firsts AS (SELECT s, min((tid, i)) AS f FROM strings GROUP BY s),
later AS (SELECT tid, i FROM strings JOIN firsts USING (s) WHERE f <> (tid, i)),
runs AS (
  SELECT tid, i, sum(CAST(coalesce(i - before > 100, true) AS INTEGER)) OVER (PARTITION BY tid ORDER BY i) AS run
  FROM (SELECT tid, i, lag(i) OVER (PARTITION BY tid ORDER BY i) AS before FROM later)
),
spans AS (SELECT tid, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY tid, run),
gaps AS (
  SELECT tid, a, b, coalesce(lag(b) OVER (PARTITION BY tid ORDER BY a), 0) AS kept_from,
    row_number() OVER (PARTITION BY tid ORDER BY a DESC) = 1 AS is_last FROM spans
),
parts AS (
  SELECT tid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)) || CASE WHEN is_last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM gaps JOIN texts USING (tid) GROUP BY tid
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
FROM d JOIN texts ON texts.h = d.h AND texts.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN parts USING (tid)"""
