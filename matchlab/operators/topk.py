"""Sort, limit, top-k, sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import attach_one_row


def value_frequencies(df: DataFrame, col: str, alias: str = "n") -> DataFrame:
    """Non-null value counts (map-side combined)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(alias))


def top_k_counts(df: DataFrame, col: str, k: int, alias: str = "n", counts: DataFrame | None = None
                 ) -> DataFrame:
    """The k most frequent non-null values (ties broken by value).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each partition
    keeps its own top k, so only k x partitions rows reach the final merge."""
    c = value_frequencies(df, col, alias) if counts is None else counts
    return c.orderBy(F.col(alias).desc(), F.col(col).asc()).limit(k)


def top_k_or_other(df: DataFrame, col: str, k: int, other: str, out: str | None = None) -> DataFrame:
    """O2 + J10: keep values among the k most frequent, relabel the rest (and
    nulls) as ``other`` - only when there are more than k distinct values.
    The top list and the category count come from one frequency table."""
    out = out or col
    freq = value_frequencies(df, col)
    top = top_k_counts(df, col, k, counts=freq).select(F.col(col).alias("_top"))  # at most k rows
    n_cat = freq.agg(F.count(F.lit(1)).alias("_ncat"))
    j = attach_one_row(df, n_cat).join(F.broadcast(top), F.col(col) == F.col("_top"), "left")
    label = (F.when(F.col("_ncat") <= k, F.col(col))
             .when(F.col("_top").isNotNull(), F.col(col))
             .otherwise(F.lit(other)))
    return j.withColumn(out, label).drop("_top", "_ncat")




def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """O3 head(n) made deterministic by an explicit total order."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """O3 sample(n): a seeded pseudo-random order over a row key, first n rows.

    The random key is a hash of the row key and the seed, so the sample is the
    same on recomputation (unlike ``rand()`` under task retries)."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return df.withColumn("_r", h).orderBy("_r", *key).limit(n).drop("_r")




def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

