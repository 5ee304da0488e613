"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, secret scan, SentencePiece.

``run(spark, sf_dir)`` applies STAGES to ``documents``. Each stage works on all that the
stage before kept, is written to the shared folder as Parquet, and is read again by the
next one. All stages but the last return the columns of ``documents``.

The stages cannot be stated in SQL as a whole (a learned language model, seeded merges of
a tokenizer), so ORACLE_SQL is None and tests compare each stage with a plain version.
Cases such as nulls, empty texts and repeated rows are defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchlab.llm import decontaminate, langid, minhash, pieces, secret_scan
from matchlab.llm.store import written
from matchlab.session import table_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text gets a language; the others (no text, no letter, no learned language) go."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle sets of Jaccard 0.8 or more."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks; n_chars follows the text."""
    return secret_scan.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and pieces of every document; each decodes to its text."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
