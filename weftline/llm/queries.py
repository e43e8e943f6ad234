"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, near_dup, packing, quality_rules, run_length_index, sharding, substring_dedup, url_filters, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


OP1_SQL = r"""
WITH pieces AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n', e'\n\x01', 'g'), '([.!?][ \t\x0B\x0C\r])', e'\\1\x01', 'g'), e'\x01') AS parts
  FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM pieces),
placed AS (SELECT doc_id, part, k, coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM numbered),
normal AS (
  SELECT doc_id, part, k, start, start + strlen(part) AS "end",
         regexp_replace(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+', ' ', 'g'), '^ | $', '', 'g') AS norm
  FROM placed),
ranked AS (
  SELECT *, norm <> '' AND len(string_split(norm, ' ')) >= 8 AS big,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS later
  FROM normal)
SELECT doc_id, sum(strlen(part))::BIGINT AS n_bytes, coalesce(sum(strlen(part)) FILTER (big AND later), 0)::BIGINT AS n_removed,
       count(*) FILTER (big AND later) AS n_spans,
       coalesce(string_agg(start || '-' || "end" || ',', '' ORDER BY k) FILTER (big AND later), '') AS spans,
       sha256(coalesce(string_agg(part, '' ORDER BY k) FILTER (NOT (big AND later)), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""


def op2_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=packing.Capacity(tokens=1024))


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dups(_table(spark, sf_dir, "documents"), width=2)


def op6_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(_table(spark, sf_dir, "documents"))


def op7_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), n=40)


#: The rules of the query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(_table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
keyed AS (SELECT row_number() OVER () AS k, coalesce(host, '') AS host, coalesce(path, '') AS path, page_id FROM parts),
fits AS (
  SELECT k, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
  FROM keyed JOIN rules ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM keyed LEFT JOIN fits USING (k)
"""


def op9_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_vector_best_fit,
        op3_run_length_index,
        op4_quality_rules,
        op5_minhash_near_dedup,
        op6_wavelet_matrix,
        op7_balanced_label_propagation,
        op8_url_range_join,
        op9_greedy_tiling,
        op10_warc_round_trip,
    )
}
SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op8_url_range_join": OP8_SQL, "op10_warc_round_trip": OP10_SQL}
