"""Distinct counts from stored sketches (A2-A4, opt-in).

A distinct count can't be added up over groups; a HyperLogLog sketch can be merged. One
sketch for each finest group (place, year, state ...) is stored once; a count under any
filter on those columns, at any coarser grain, merges some sketches of a few KB and never
reads the facts again. Rows whose group is null have their own sketches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch as a power of two.
LG_K = 12


def distinct_sketches(df: DataFrame, col: str, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(by..., sketch): a sketch of the values of ``col`` in each group; nulls don't count."""
    return df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(col, lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = (), where: Column | None = None,
                    alias: str = "n_distinct") -> DataFrame:
    """Estimated distinct values by ``by`` (none: one row, 0 if nothing is left) of the groups that pass
    ``where``; a filter on a partition column of the stored sketches reads those folders only."""
    s = sketches if where is None else sketches.where(where)
    n = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias(alias)
    return s.groupBy(*by).agg(n) if by else s.agg(n)


def error_bound(lg_k: int = LG_K, sigmas: float = 4.0) -> float:
    """Relative error of a merged estimate that ``sigmas`` standard deviations allow."""
    return sigmas * 1.04 / math.sqrt(2 ** lg_k)
