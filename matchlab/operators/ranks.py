"""Exact order statistics without a single-task sort (W4 and the exact quantiles).

``exact_quantiles`` finds the values at its target ranks by radix selection: digit by
digit of an order-preserving 64-bit key, from counters that merge by addition (see its
docstring).

``cumulative_before`` serves the rank statistics, which need a running count
at *every* value.  It starts from a value-count table - one row per distinct
``(by..., value)`` with one or more count columns (map-side combined, so a
value repeated a billion times is one row) - and adds, for every count
column ``c``, ``c_before`` = total of ``c`` over strictly smaller values of
the same ``by`` group.  The table is dealt out by ranges of (by..., value) with
sampled bounds, so a hot group is spread over as many ranges as it fills; the
totals of the ranges get a prefix sum, and a window inside each range adds the
running count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import catalog
from .joins import few

#: Bits of a digit: a pass counts at most 2^16 digits of an interval, and four passes
#: reach the last bit of a key.
DIGIT_BITS = 16
#: Bits of a double behind its exponent, and the exponent's offset.
_MANTISSA, _BIAS = 52, 1023


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "cnt",
                 weight: Column | None = None) -> DataFrame:
    """(by..., value, cnt) over non-null, non-NaN values."""
    v = F.col(value)
    d = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    for b in by:  # null group keys are dropped (pandas groupby semantics)
        d = d.filter(F.col(b).isNotNull())
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return d.groupBy(*by, value).agg(agg.alias(count))


def cumulative_before(vc: DataFrame, value: str, count_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_before`` for every count column (see module doc)."""
    by = list(by)
    order = [*by, value]
    r = vc.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # written: the ranges must be the same for the totals and for the rows
    r = catalog.written(r, "ranges")
    tot = r.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in count_cols])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("_part", *by, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in count_cols])
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = r.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in count_cols])
    return r.join(tot, ["_part", *by]).select(
        *vc.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"{c}_before") for c in count_cols])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, cnt, rank) with average rank for ties (1-based)."""
    c = cumulative_before(value_counts(df, value, by), value, ["cnt"], by)
    return c.withColumn("rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2.0)


def with_order_key(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Add the order-preserving 64-bit key of a double that isn't null or NaN: the bits of its
    magnitude (exponent, then mantissa), negated below zero. Both zeros have the key 0."""
    # Steps are columns of their own, so that nothing is computed twice and the code of a
    # stage stays small enough for the compiler. Below 2^-1022 the ratio alone is the bits
    # (zero has no logarithm).
    d = df.withColumn("_a", F.abs(F.col(value).cast("double")))
    d = d.withColumn("_e", F.greatest(F.least(F.coalesce(F.floor(F.log2("_a")), F.lit(1 - _BIAS)), F.lit(_BIAS)), F.lit(1 - _BIAS)))
    d = d.withColumn("_r", F.col("_a") / F.pow(F.lit(2.0), F.col("_e")))
    e, r = F.col("_e"), F.col("_r")
    # next to a power of two the logarithm may miss the exponent by one; the ratio tells
    over = F.when((r < 1) & (e > 1 - _BIAS), 2 * r - 2).when(r >= 2, r / 2).otherwise(r - 1)
    bits = F.when(r > 4, F.lit((2 * _BIAS + 1) << _MANTISSA)) \
        .otherwise((e + _BIAS) * (1 << _MANTISSA) + (over * 2.0 ** _MANTISSA).cast("long"))
    return d.withColumn(alias, bits * F.when(F.col(value) < 0, -1).otherwise(1)).drop("_a", "_e", "_r")


def key_value(key: Column) -> Column:
    """The double of an order-preserving key."""
    bits = F.abs(key)
    e = F.shiftright(bits, _MANTISSA)
    m = bits.bitwiseAND((1 << _MANTISSA) - 1).cast("double")
    a = F.when(e == 0, m * 2.0 ** -537 * 2.0 ** -537).when(e > 2 * _BIAS, F.lit(float("inf"))) \
        .otherwise((1 + m * 2.0 ** -_MANTISSA) * F.pow(F.lit(2.0), (e - _BIAS).cast("double")))
    return F.when(key < 0, -a).otherwise(a)


def _narrowed(counters: DataFrame, keys: list[str], inside: list[str]) -> DataFrame:
    """The next interval of every target from the counters (_digit, _c, _lo, _hi) of the
    interval ``inside`` that holds it, whose first row has the rank ``_off``; ``_targets`` has its
    targets. A target at the interval's first or last row is its end already."""
    before = Window.partitionBy(*keys, *inside).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("_off") + F.coalesce(F.sum("_c").over(before), F.lit(0))
    t = F.filter("_targets", lambda t: (t["rank"] >= F.col("_off")) & (t["rank"] < F.col("_off") + F.col("_c")))
    c = counters.withColumn("_off", off).select(*keys, "_last", "_off", "_c", "_lo", "_hi", F.explode(t).alias("_t"))
    first, last = F.col("_t.rank") == F.col("_off"), F.col("_t.rank") == F.col("_off") + F.col("_c") - 1
    return c.select(*keys, "_last", "_t", F.when(last & ~first, F.col("_t.rank")).otherwise(F.col("_off")).alias("_off"),
                    F.when(last & ~first, F.col("_hi")).otherwise(F.col("_lo")).alias("_lo"),
                    F.when(first, F.col("_lo")).otherwise(F.col("_hi")).alias("_hi"))


def _digit_pass(d: DataFrame, state: DataFrame, keys: list[str], wide: bool) -> DataFrame:
    """One more digit: rows of d inside an open interval are counted by its 2^16 parts."""
    iv = state.groupBy(*keys, "_last", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_off") \
        .agg(F.collect_list("_t").alias("_targets"))
    # one row per group and target: small, and broadcast behind a check of its rows
    j = d.join(iv if wide else few(iv), keys).where("_x BETWEEN _from AND _to")
    digit = F.expr(f"(_x - _from) div ((_to - _from) div {1 << DIGIT_BITS} + 1)")
    c = j.groupBy(*keys, "_last", "_from", "_to", "_off", "_targets", digit.alias("_digit")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return _narrowed(c, keys, ["_from", "_to", "_off"])


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), wide: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles (``quantile_cont``): (by..., q, value_q).

    For position p = q (n - 1) the result is v[floor p] + (p - floor p)(v[ceil p] - v[floor p]).
    Radix selection; rows stay where they are, and nothing runs before an action:

    1. every row is counted by the first 16 bits of its key (``with_order_key``), with the
       least and greatest key of each counter. Counters are combined before the shuffle; a
       window over at most 2^16 of a group finds the one that holds a target rank;
    2. the interval from its least to its greatest key is cut into 2^16 parts, and the
       rows inside (of all rows, those whose key lies in a target's interval) are counted by
       part. An interval of one value, or a target at its end, is done: a tie of any
       size needs no more work;
    3. two more passes reach the last bit. Mostly two digits find every target; then the
       table of open intervals is empty and Spark drops these passes and their scans.

    The intervals, a row per group and target, are broadcast behind a check of their number
    (``joins.few``); ``wide`` leaves that join to Spark, for groups beyond the check's bound.
    Infinite values are ordinary ones; between two of them there is no interpolation.
    """
    by = list(by)
    keys = by if by else ["_k"]
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull() & ~F.isnan(v))
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    d = d.select(*by, v.alias("_v")) if by else d.select(F.lit(0).alias("_k"), v.alias("_v"))
    d = with_order_key(d, "_v", "_x").drop("_v")

    c = d.groupBy(*keys, F.shiftright("_x", 64 - DIGIT_BITS).alias("_digit")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    c = c.withColumn("_last", F.sum("_c").over(Window.partitionBy(*keys)) - 1)
    # whole numbers only: targets are part of grouping keys
    targets = [F.struct(F.lit(i).alias("i"), F.lit(side).alias("up"), at(float(q) * F.col("_last")).alias("rank"))
               for i, q in enumerate(qs) for side, at in ((False, F.floor), (True, F.ceil))]
    first = _narrowed(c.select("*", F.array(*targets).alias("_targets"), F.lit(0).cast("long").alias("_off")), keys, [])
    second = _digit_pass(d, first, keys, wide)
    # grouped, so that both readers of this table share its exchange
    second = second.groupBy(*second.columns).agg(F.max(F.col("_lo") < F.col("_hi")).alias("_open"))
    rest = _digit_pass(d, _digit_pass(d, second.where("_open"), keys, wide), keys, wide)
    done = second.where("NOT _open").drop("_open").unionByName(rest)

    x = key_value(F.col("_lo"))
    r = done.groupBy(*keys, F.col("_t.i").alias("_i")).agg(
        F.max(F.when(~F.col("_t.up"), x)).alias("_a"), F.max(F.when(F.col("_t.up"), x)).alias("_b"), F.max("_last").alias("_last"))
    r = r.withColumn("q", F.get(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i")))
    part = F.col("q") * F.col("_last") - F.floor(F.col("q") * F.col("_last"))
    between = F.col("_a") + part * (F.col("_b") - F.col("_a"))
    return r.select(*by, "q", F.when((part == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(between).alias("value_q"))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), alias: str = "median", wide: bool = False) -> DataFrame:
    q = exact_quantiles(df, value, [0.5], by, wide)
    return q.select(*by, F.col("value_q").alias(alias))
