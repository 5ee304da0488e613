"""Window operators (W1-W3, W5, W6) and catalogue helpers.

Windows over raw rows are always partitioned by a key (W1).  The
unpartitioned windows (W5 cumulative share, W6 ordinal position) only run on
aggregated rows whose count is bounded by a label domain or a year range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import qualified_name


def best_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON (key) ... ORDER BY key, order...: the first row per key.

    ``row_number() == 1`` is planned as a WindowGroupLimit (per-partition
    top-1 before the shuffle's sort), so no global sort happens."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def owner_first(c: str | Column) -> Column:
    """Sort key putting owner-equal rows first (CASE WHEN eq THEN 0 ELSE 1 END)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, F.lit(0)).otherwise(F.lit(1))


def states_per_name(df: DataFrame, name: str, state: str) -> DataFrame:
    """W2 (intended meaning): number of distinct states per place name."""
    d = df.select(name, state).filter(F.col(name).isNotNull()).distinct()
    return d.groupBy(name).agg(F.count(state).alias("n_ufs"))


def qualified_places(df: DataFrame, name: str, state: str, row_count_parity: bool = False) -> DataFrame:
    """P27: 'name - UF' when the name occurs in more than one state, else the name.

    ``row_count_parity`` reproduces the reference's quirk instead: its window
    count runs before DISTINCT, so any name with more than one *row* gets the
    suffix."""
    d = df.select(name, state).filter(F.col(name).isNotNull()).distinct()
    if row_count_parity:
        n = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n_ufs"))
    else:
        n = states_per_name(d, name, state)
    j = d.join(n, name)
    return j.select(qualified_name(name, state, "n_ufs").alias("place"),
                    F.col("n_ufs").cast("long").alias("n_ufs"))


def dimension_catalog(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value) distinct non-null values of several columns, one scan."""
    lg = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims
    ])).alias("s")).select("s.*")
    return lg.filter(F.col("value").isNotNull()).distinct().orderBy("dimension", "value")


def series_endpoints(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last point of each ordered series (min_by / max_by, no sort)."""
    aggs = [F.min(x).alias("x_first"), F.min_by(y, x).alias("y_first"),
            F.max(x).alias("x_last"), F.max_by(y, x).alias("y_last")]
    d = df.filter(F.col(x).isNotNull())
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def cumulative_share(df: DataFrame, order: str, share: str, by: Sequence[str] = (),
                     gap: float = 0.0) -> DataFrame:
    """Running offset (sum of the previous shares + gaps) and centre per row,
    along a fixed order.  Input is an aggregated table (one row per label)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    n_prev = F.count(F.lit(1)).over(prev)
    off = F.coalesce(F.sum(share).over(prev), F.lit(0.0)) + n_prev * gap
    return df.withColumn("offset", off).withColumn("centre", F.col("offset") + F.col(share) / 2)


def ordinal_position(df: DataFrame, x: str, by: Sequence[str] = (), alias: str = "pos") -> DataFrame:
    """0-based position of each period in its series (aggregated rows)."""
    w = Window.partitionBy(*by).orderBy(x) if by else Window.orderBy(x)
    return df.withColumn(alias, F.row_number().over(w) - 1)
