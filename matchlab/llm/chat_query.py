"""Query of chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import chat

#: The conversation that the contract adds; both its turns hold control strings.
ADDED_TEXT = r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, '### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
                      WHEN 'tool' THEN 'Tool' ELSE 'role=' || url_encode(role) END || ': '
         || regexp_replace(text, '(\\*)(### (?:User|Assistant|System|Tool|role=[^\s:]*): |</turn>)', '\\\1\2', 'g')
         || chr(10) || '</turn>' || chr(10) AS shown
  FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests read back from the output."""
    rows = spark.read.parquet(table_path(sf_dir, "conversations")).select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    added = added.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns])
    out = chat.format_conversations(rows.unionByName(added))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substring(
        F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumn("_loss", under)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
