"""Aggregations.

All results are small aggregated DataFrames; partial (map-side) aggregation
happens before every shuffle.  Exact medians / quantiles use
``ranks.exact_quantiles`` (radix selection, no per-group value map in one task); ``method="builtin"`` switches to Spark's ``percentile`` (fine
when the number of distinct values per group is small) and
``method="approx"`` to ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import high_flag
from . import ranks
from .joins import attach_one_row, full_join_counts


def _quantile_table(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str],
                    method: str, wide: bool = False) -> DataFrame:
    """(by..., q, value_q) by the chosen method."""
    by = list(by)
    if method == "exact":
        return ranks.exact_quantiles(df, value, qs, by, wide)
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull() & ~F.isnan(v))
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    if method == "builtin":
        agg = F.percentile(v, list(qs))
    elif method == "approx":
        agg = F.percentile_approx(v, list(qs), 10000)
    else:
        raise ValueError(method)
    t = d.groupBy(*by).agg(agg.alias("_qs"))
    return t.select(*by, F.posexplode("_qs").alias("_i", "value_q")).select(
        *by, F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1).alias("q"), "value_q")


def group_quantiles_wide(df: DataFrame, value: str, qs: Mapping[str, float], by: Sequence[str] = (),
                         method: str = "exact", wide: bool = False) -> DataFrame:
    """One row per group with one column per named quantile; ``wide`` as in ``exact_quantiles``."""
    by = list(by)
    names = list(qs)
    t = _quantile_table(df, value, [qs[n] for n in names], by, method, wide)
    aggs = [F.max(F.when(F.col("q") == float(qs[n]), F.col("value_q"))).alias(n) for n in names]
    return t.groupBy(*by).agg(*aggs) if by else t.agg(*aggs)


# --- A1: KPI row -----------------------------------------------------------

def kpi_row(df: DataFrame, index: str = "indice", state: str = "estado", area: str = "area_a",
            flag: str = "cpf_ok", method: str = "exact") -> DataFrame:
    """total_records, avg/median index (x100), distinct states, total area,
    mean owner flag (x100); empty input gives zeros."""
    base = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(index).alias("_avg"),
        F.countDistinct(state).alias("num_ufs"),
        F.sum(area).alias("_area"),
        F.avg(F.col(flag).cast("double")).alias("_flag"),
    )
    med = group_quantiles_wide(df, index, {"_median": 0.5}, (), method)
    # scalar subquery: NULL (then 0) when the input is empty
    j = base.withColumn("_median", med.select("_median").scalar())
    return j.select(
        F.col("total_records").cast("long").alias("total_records"),
        F.coalesce(F.col("_avg") * 100, F.lit(0.0)).alias("avg_jaccard"),
        F.coalesce(F.col("_median") * 100, F.lit(0.0)).alias("median_jaccard"),
        F.col("num_ufs").cast("long").alias("num_ufs"),
        F.coalesce(F.col("_area"), F.lit(0.0)).alias("total_area"),
        F.coalesce(F.col("_flag") * 100, F.lit(0.0)).alias("avg_cpf_ok"),
    )


# --- A2, A3, A9, A10: counts ------------------------------------------------

def distinct_count(df: DataFrame, col: str, by: Sequence[str] = (), alias: str = "n_distinct",
                   approx: bool = False) -> DataFrame:
    """A2/A3: COUNT(DISTINCT col) per group (or global).

    The exact form is two-stage (distinct (by, col) then count), which Spark
    partially aggregates on both stages; ``approx`` uses HyperLogLog++."""
    by = list(by)
    d = df.filter(F.col(col).isNotNull())
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    if approx:
        agg = F.approx_count_distinct(col).alias(alias)
        return d.groupBy(*by).agg(agg) if by else d.agg(agg)
    agg = F.countDistinct(col).alias(alias)
    return d.groupBy(*by).agg(agg) if by else d.agg(agg)


def group_size(df: DataFrame, by: Sequence, alias: str = "n", dropna: bool = True) -> DataFrame:
    """Rows per group; keys may be expressions (Columns)."""
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    d = df
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
    if dropna:
        g = g.dropna(subset=[c for c in g.columns if c != alias])
    return g


# --- A4: distinct-then-sum -----------------------------------------------------

def distinct_then_sum(df: DataFrame, year: str, grain: Sequence[str], total: str,
                      alias: str = "total_cars") -> DataFrame:
    """Dedupe (year, grain..., total) then SUM(total) per year; totals repeated
    on many fact rows are counted once per grain."""
    d = df.filter(F.col(year).isNotNull() & F.col(total).isNotNull())
    return (d.select(year, *grain, F.col(total).alias("_t")).distinct()
            .groupBy(year).agg(F.sum("_t").alias(alias)))


def registered_totals_by_year(df: DataFrame, spec, year: str = "ano_cadastro", place_key: str = "idt_municipio",
                              state: str = "estado", place_total: str = "total_cars_municipio",
                              state_total: str = "total_cars_cadastrados", alias: str = "total_cars") -> DataFrame:
    """A4 with its grain rule: per-place totals when places are selected,
    per-state totals otherwise; only the geographic part of the filter spec
    applies (size / status are not, as in the reference, survey Q17)."""
    from .filters import FilterSpec
    geo = FilterSpec(regions=spec.regions, states=spec.states, places=spec.places, cols=spec.cols).resolved()
    d = geo.apply(df)
    if spec.places:
        return distinct_then_sum(d, year, [place_key], place_total, alias)
    return distinct_then_sum(d, year, [state], state_total, alias)


# --- A5, A6, A7: grouped statistics -----------------------------------------

def group_median(df: DataFrame, by: Sequence[str], value: str, alias: str = "median",
                 method: str = "exact", wide: bool = False) -> DataFrame:
    """A5; ``wide`` (as in ``exact_quantiles``) for keys of any number of groups."""
    return group_quantiles_wide(df, value, {alias: 0.5}, by, method, wide)


def group_flag_rate(df: DataFrame, by: Sequence[str], flag: str, alias: str = "pct") -> DataFrame:
    """Mean of a 0/1 flag x 100 per group."""
    d = reduce(lambda a, b: a.filter(F.col(b).isNotNull()), by, df)
    return d.groupBy(*by).agg((F.avg(F.col(flag).cast("double")) * 100).alias(alias))


def area_scorecard(df: DataFrame, geo: Sequence[str], index: str = "indice", flag: str = "cpf_ok",
                   region: str = "regiao", threshold: float = 0.85) -> DataFrame:
    """% rows with index >= threshold (null counts as below), % owner equal,
    region of the area (deterministic min instead of first), row count."""
    d = reduce(lambda a, b: a.filter(F.col(b).isNotNull()), geo, df)
    hi = high_flag(index, threshold).cast("double")
    return d.groupBy(*geo).agg(
        (F.avg(hi) * 100).alias("pct_espacial_bom"),
        (F.avg(F.col(flag).cast("double")) * 100).alias("pct_cpf_igual"),
        F.min(region).alias("regiao"),
        F.count(F.lit(1)).alias("total_cars"),
    )


# --- A8: conditional-sum pivot --------------------------------------------------

def yearly_pivot(df: DataFrame, keys: Sequence[str], year: str, value: str, years: Sequence[int],
                 prefix: str = "d") -> DataFrame:
    """SUM(value) FILTER (WHERE year = y) per key for a fixed year list, 0 when absent.

    One pass of conditional sums (no pivot-value discovery job)."""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col(year) == y, F.col(value))), F.lit(0.0)).alias(f"{prefix}{y}")
        for y in years])


# --- A11: time series -------------------------------------------------------------

def series_agg(df: DataFrame, x: str, value: str, agg: str = "mean", hue: str | None = None,
               alias: str = "value", method: str = "exact") -> DataFrame:
    """Aggregate ``value`` per x (and series ``hue``): mean / median / sum."""
    by = [x] + ([hue] if hue else [])
    d = reduce(lambda a, b: a.filter(F.col(b).isNotNull()), by, df)
    if agg == "median":
        return group_median(d, by, value, alias, method)
    fn = {"mean": F.avg, "sum": F.sum}[agg]
    return d.groupBy(*by).agg(fn(value).alias(alias))


# --- A12-A16: frequency and contingency tables -----------------------------------

def freq_share(df: DataFrame, col: str, alias_n: str = "n", alias_pct: str = "pct") -> DataFrame:
    """Value counts and share (x100) of the non-null total."""
    c = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(alias_n))
    tot = c.agg(F.sum(alias_n).alias("_tot"))
    return attach_one_row(c, tot).select(
        col, alias_n, (F.col(alias_n) / F.col("_tot") * 100).alias(alias_pct))


def crosstab_counts(df: DataFrame, row: str, col: str, alias: str = "n") -> DataFrame:
    """Long contingency counts; rows with a null in either key are dropped."""
    return (df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row, col).agg(F.count(F.lit(1)).alias(alias)))


def normalized_share(counts: DataFrame, over: Sequence[str], n: str = "n", alias: str = "pct") -> DataFrame:
    """N / sum(n) within ``over`` x 100 on the (small) count table."""
    w = Window.partitionBy(*over)
    return counts.withColumn(alias, F.col(n) / F.sum(n).over(w) * 100)


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cells, row totals, column totals and grand total in one GROUPING
    SETS aggregation, with each cell's share of the grand total."""
    d = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    g = (d.cube(row, col).agg(F.count(F.lit(1)).alias("n"),
                              F.grouping_id().alias("_gid")))
    level = (F.when(F.col("_gid") == 0, F.lit("cell")).when(F.col("_gid") == 1, F.lit("row_total"))
             .when(F.col("_gid") == 2, F.lit("col_total")).otherwise(F.lit("grand_total")))
    tot = g.filter(F.col("_gid") == 3).select(F.col("n").alias("_grand"))
    return attach_one_row(g, tot).select(
        F.coalesce(F.col(row), F.lit("__all__")).alias(row),
        F.coalesce(F.col(col), F.lit("__all__")).alias(col),
        level.alias("level"), "n", (F.col("n") / F.col("_grand") * 100).alias("pct_total"))


# --- A17-A20: profiles --------------------------------------------------------------

def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols
    ])).alias("_s")).select("_s.column", "_s.value")


def numeric_profile(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Per numeric column mean, median, sample std, min, max (long form)."""
    lg = _long(df, cols, "double").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    base = lg.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))
    med = group_quantiles_wide(lg, "value", {"median": 0.5}, ["column"], method)
    return base.join(med, "column", "left")


def describe_quartiles(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per column (long form)."""
    lg = _long(df, cols, "double").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    base = lg.groupBy("column").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    q = group_quantiles_wide(lg, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"], method)
    return base.join(q, "column", "left")


def group_profile(df: DataFrame, by: str, value: str, method: str = "exact") -> DataFrame:
    """N, mean, median, population std, min, max per group (null rows dropped)."""
    d = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    base = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                             F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
                             F.max(value).alias("max"))
    med = group_median(d, [by], value, "median", method)
    return base.join(med, by, "left")


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per string column: value, count and share of the column's non-null rows."""
    lg = _long(df, cols, "string").filter(F.col("value").isNotNull())
    c = lg.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return normalized_share(c, ["column"], "n", "pct")


# --- A21-A25 ----------------------------------------------------------------------

def join_coverage(df: DataFrame, col: str) -> DataFrame:
    """Matched / unmatched rows and matched percent after a left join (0 without rows)."""
    return df.agg(F.count(col).alias("matched"),
                  (F.count(F.lit(1)) - F.count(col)).alias("unmatched"),
                  F.coalesce(F.try_divide(F.count(col), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("pct_matched"))


def extents(df: DataFrame, col: str) -> DataFrame:
    """Min, max and span of a column."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"),
                  (F.max(col) - F.min(col)).alias("span"))


def overview(df: DataFrame, distinct: Mapping[str, str], extent: Mapping[str, str]) -> DataFrame:
    """A3 + A22 in one scan: COUNT(DISTINCT) as each name of ``distinct``, and min, max and span
    as <name>_min, <name>_max, <name>_span of each name of ``extent``."""
    aggs = [F.countDistinct(c).cast("long").alias(n) for n, c in distinct.items()]
    for n, c in extent.items():
        aggs += [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), (F.max(c) - F.min(c)).alias(f"{n}_span")]
    return df.agg(*aggs)


def legend_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Min, median, max."""
    return group_quantiles_wide(df, value, {"q_min": 0.0, "q_mid": 0.5, "q_max": 1.0}, by, method)


def minmax_rescale(df: DataFrame, col: str, lo: float = 100.0, hi: float = 800.0,
                   alias: str = "size") -> DataFrame:
    """(x - min) / (max - min) * (hi - lo) + lo; constant lo when min = max."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = attach_one_row(df, mm)
    x, mn, mx = F.col(col).cast("double"), F.col("_mn").cast("double"), F.col("_mx").cast("double")
    return j.withColumn(alias, F.when(mn == mx, F.lit(lo))
                        .otherwise((x - mn) / (mx - mn) * (hi - lo) + lo)).drop("_mn", "_mx")


def count_and_first(df: DataFrame, by: Sequence[str], count_col: str, attr: str,
                    alias_n: str = "n", alias_attr: str | None = None) -> DataFrame:
    """Count of ``count_col`` and the attribute per group.

    pandas 'first' depends on row order; a distributed table has none, so the
    smallest non-null attribute is taken (identical when it is constant per group)."""
    return df.groupBy(*by).agg(F.count(count_col).alias(alias_n),
                               F.min(attr).alias(alias_attr or attr))


# --- A30, A31 ---------------------------------------------------------------------

def part_of_total(part: DataFrame, total: DataFrame, key: str, part_col: str, total_col: str,
                  alias: str = "pct") -> DataFrame:
    """Full join of part and total per key, zero filled, safe percentage."""
    j = full_join_counts(part, total, [key], {part_col: 0, total_col: 0})
    return j.withColumn(alias, F.when(F.col(total_col) > 0, F.col(part_col) / F.col(total_col) * 100)
                        .otherwise(F.lit(0.0)))


def match_rate(entities: DataFrame, key: str, group: str, matched_keys: DataFrame,
               alias: str) -> DataFrame:
    """Share (x100) of the entities of each group whose key appears in
    ``matched_keys`` (flag via left join to the de-duplicated key set)."""
    mk = matched_keys.select(F.col(matched_keys.columns[0]).alias(key)).distinct() \
        .withColumn("_hit", F.lit(1.0))
    j = entities.select(key, group).join(mk, key, "left")
    return j.groupBy(group).agg((F.avg(F.coalesce(F.col("_hit"), F.lit(0.0))) * 100).alias(alias),
                                F.count(F.lit(1)).alias(f"n_{alias}"))


def two_way_match(rate_a: DataFrame, rate_b: DataFrame, group: str) -> DataFrame:
    """Both directional match rates per group (full join)."""
    return rate_a.join(rate_b, group, "full")
