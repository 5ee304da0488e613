"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import pagetext


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with the lines that its nearest page shares, and those that go by
    the difference and by rule."""
    out = pagetext.main_text(spark.read.parquet(table_path(sf_dir, "pages")))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_deleted", "n_ruled")
