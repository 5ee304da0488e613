"""Queries of decontamination and of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import decontaminate, minhash

DECONTAMINATE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - CAST(n AS BIGINT) + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + CAST(n AS BIGINT))) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM d, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS t(i) WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, z.n
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items they come from."""
    out = decontaminate.mark(spark.read.parquet(table_path(sf_dir, "documents")),
                             spark.read.parquet(table_path(sf_dir, "benchmark")))
    n = decontaminate.n_hit()
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard of 0.85."""
    out = minhash.near_duplicates(spark.read.parquet(table_path(sf_dir, "documents")), shingle=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
