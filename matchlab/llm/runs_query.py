"""Query of periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import runs

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END)
                         ELSE w END AS w FROM p),
five AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS five FROM d, unnest(range(0, n - 4)) AS t(i)),
pairs AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i
          AND y.i - x.i <= x.n // 4),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
-- words q apart agree from the first to five words behind the last start
runs AS (SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM isles GROUP BY doc_id, q, isle),
r AS (SELECT doc_id, s, e, min(q) AS q FROM runs WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
dropped AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(s + q, e)) AS t(i)),
drops AS (SELECT doc_id, list(i) AS gone FROM dropped GROUP BY doc_id),
text AS (
  SELECT d.doc_id, array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
    list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ') AS t
  FROM d LEFT JOIN drops USING (doc_id)),
best AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY e - s DESC, s, q) AS s, first(e ORDER BY e - s DESC, s, q) AS e,
                first(q ORDER BY e - s DESC, s, q) AS q, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS runs
         FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(e - s AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * (e - s) // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(t) AS collapsed_sha256
FROM text LEFT JOIN best USING (doc_id)
"""


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) is a multiple of ten, from a word chosen by it on the
    words go round in a period chosen by it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    d = d.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    round_ = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), round_), F.lit(1), F.col("n")), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, and the text without their repetitions."""
    out = runs.word_runs(repeated(spark.read.parquet(table_path(sf_dir, "documents"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("r"))))["r"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
