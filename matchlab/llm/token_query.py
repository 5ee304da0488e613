"""Query of token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path
from . import tokens


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by the separators of flat token files made of them."""
    return tokens.document_token_counts(spark.read.parquet(table_path(sf_dir, "documents")))
