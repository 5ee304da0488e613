"""Queries of language ID, toxicity and SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import langid, pieces, toxicity


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    known = docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    out = langid.predict(docs, langid.learn(known))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones that aren't held out."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    out = toxicity.score(docs, toxicity.learn(toxicity.training_rows(docs, labels)))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under merge dropout; each was decoded to its text exactly."""
    return pieces.encode_texts(spark.read.parquet(table_path(sf_dir, "documents")))
