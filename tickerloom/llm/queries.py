"""The registered queries of the operators, and their DuckDB statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import (
    attribution,
    bpe,
    centroids,
    divergence,
    html,
    mpegts,
    packing,
    pii,
    pstable,
    quality,
    repeats,
    secrets,
    simhash,
)
from tickerloom.llm import statements
from tickerloom.llm.common import table, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: The key of the registered query; a job passes its own.
SURROGATE_KEY = "registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def owner() -> Column:
    return F.col("source")


def repository() -> Column:
    """A source keeps one repository per language."""
    return F.struct("source", "lang")


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, their values classified by the owners and repositories that hold them."""
    found = secrets.report(table(spark, sf_dir, "documents"), owner(), repository())
    base = F.transform(
        "findings", lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")

    def values(group: str) -> Column:
        return F.size(F.filter("found", lambda v: v["class"] == group)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, _, _ in secrets.KINDS),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(secrets.all_spans(F.col("found"), F.col("findings"))).alias("spans"),
        *(values(group).alias(f"n_{group}") for group in secrets.CLASSES),
    )


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded, long ones as trees of parts, and decoded again."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        "n_tokens",
        "ids_sha256",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked at a cosine of 0.9."""
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, and outside the lines."""
    return attribution.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts stored as transport streams in a table, read back from it."""
    media, _ = written(mpegts.to_media(table(spark, sf_dir, "documents")), "media")
    points = F.filter("units", lambda u: u["random_access"])
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("programs="), "programs"),
        F.concat(F.lit("streams="), "streams"),
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("continuity_errors="), "continuity_errors"),
        F.concat(F.lit("units="), F.size("units")),
        F.concat(F.lit("random_access="), F.size(points)),
        F.concat(F.lit("last_pts="), F.array_max(F.transform("units", lambda u: u["pts"]))),
    )
    return mpegts.from_media(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -mpegts.ALIGN, mpegts.ALIGN)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
        "continuity_errors",
        F.transform(points, lambda u: u["pts"]).alias("random_access_pts"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at three or fewer differing fingerprint bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a machine fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), machine).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed_columns(packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE)))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in eight clusters after ten rounds."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that begin earlier."""
    return repeats.deduplicated(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the other sources and against its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_html_main_text": op6_html_main_text,
    "op7_media_columns": op7_media_columns,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_scores": op9_quality_scores,
    "op10_packing": op10_packing,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

_ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)


def _matches(order: int, kind: str, pattern: str, least: int) -> str:
    return f"""
SELECT rid, {order} AS ord, '{kind}' AS kind, {least} AS least,
       unnest(range(len(m))) AS i, unnest(m) AS match, unnest(v) AS value, unnest(g[1:len(m)]) AS gap,
       unnest(g[2:len(m) + 1]) AS after
FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', 1) AS v,
             string_split_regex(t, '{pattern}') AS g FROM d)"""


ORACLES: dict[str, str] = {
    "op11_centroid_clusters": statements.CENTROIDS,
    "op12_suffix_dedup": statements.SUFFIXES,
    "op13_source_divergence": statements.DIVERGENCE,
    "op2_secret_ownership": f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source, lang FROM documents
),
raw AS ({_matches(0, "assign", _ASSIGN, 6)}
  UNION ALL {_matches(1, "access", "(AKIA[A-Z0-9]+)", 20)}
  UNION ALL {_matches(2, "hex", "([0-9a-f]+)", 24)}
),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY rid, ord ORDER BY i) AS BIGINT) AS stop FROM raw
),
base AS MATERIALIZED (
  SELECT rid, ord, kind, value, stop - length(match) AS start, stop, stop - length(value) AS value_start,
    right(gap, 32) AS ahead, left(after, 32) AS behind
  FROM placed WHERE length(value) >= least
),
places AS (
  SELECT value, source, lang FROM base JOIN d USING (rid)
  QUALIFY row_number() OVER (PARTITION BY value, ahead, behind ORDER BY source NULLS FIRST, lang NULLS FIRST) = 1
),
held AS (
  SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners,
    count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) AS repositories
  FROM places GROUP BY value
),
classed AS (
  SELECT DISTINCT rid, value_start AS start, stop, value,
    CASE WHEN owners >= 3 OR owners >= 2 AND repositories >= 6 THEN 'example'
         WHEN len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]')
              AND regexp_matches(value, '[A-Za-z]')
              AND NOT regexp_matches(value, '(?i)example|changeme|placeholder|your|dummy|sample|xxxx|test')
         THEN 'live' ELSE 'weak' END AS class
  FROM base JOIN held USING (value)
),
spans AS (
  SELECT rid, start, ord, stop, kind FROM base
  UNION ALL
  SELECT DISTINCT rid, start, CASE class WHEN 'live' THEN 4 WHEN 'example' THEN 5 ELSE 6 END, stop, class FROM classed
),
texts AS (
  SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < 3), '') AS base
  FROM spans GROUP BY rid
),
counts AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex FROM base GROUP BY rid
),
classes AS (
  SELECT rid, count(*) FILTER (WHERE class = 'live') AS n_live, count(*) FILTER (WHERE class = 'example') AS n_example,
    count(*) FILTER (WHERE class = 'weak') AS n_weak FROM classed GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak
FROM d LEFT JOIN texts USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN classes USING (rid)""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.9
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(k.n_links, 0) AS n_links, least(vec_id, coalesce(m.low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m.low, vec_id)) AS kept
FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) k USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) m USING (vec_id)""",
}
