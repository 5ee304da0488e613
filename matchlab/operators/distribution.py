"""Distribution summaries (A26-A29): histogram, kernel density, box summary, trend.

All heavy passes are group-bys over the rows, combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import group_quantiles_wide
from .joins import attach_one_row, few
from .windows import ordinal_position

SQRT_2PI = math.sqrt(2.0 * math.pi)


def _clean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value)
    d = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    for b in by:
        d = d.filter(F.col(b).isNotNull())
    return d


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """``bins`` equal-width bins over [lo, hi] (data min / max when not given);
    the top edge falls in the last bin (numpy rule).  Every bin is returned,
    empty ones with n = 0: (bin, bin_lo, bin_hi, n)."""
    d = _clean(df, value, [])
    mm = d.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    if lo is not None or hi is not None:
        mm = mm.select(F.lit(float(lo)).alias("_lo") if lo is not None else "_lo",
                       F.lit(float(hi)).alias("_hi") if hi is not None else "_hi")
    x = F.col(value).cast("double")
    span = F.col("_hi") - F.col("_lo")
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / span * bins), F.lit(bins - 1))).cast("int")
    j = attach_one_row(d, mm).filter((x >= F.col("_lo")) & (x <= F.col("_hi")))
    counts = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = attach_one_row(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), mm)
    out = grid.join(counts, "bin", "left").fillna({"n": 0})
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select("bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def kde(df: DataFrame, value: str, by: Sequence[str] = (), grid_size: int = 50, cut: float = 3.0,
        clip: tuple[float, float] | None = None, bw_adjust: float = 1.0, wide: bool = False) -> DataFrame:
    """Gaussian kernel density per group, each group normalised on its own.

    Bandwidth: Scott's rule, h = bw_adjust * stddev_samp * n^(-1/5).
    Grid: ``grid_size`` points over [min - cut h, max + cut h] clipped to ``clip``.
    The density is the direct sum over all rows: one aggregation pass, combined before the
    shuffle, adds each row's kernel at every grid point of its group, so rows stay where
    they are. The groups' statistics are broadcast behind a check of their number
    (``joins.few``); ``wide`` leaves that join to Spark.
    Output: (by..., j, x, density).
    """
    by = list(by)
    keys = by if by else ["_k"]
    v = F.col(value).cast("double")
    d = _clean(df, value, by).select(*by, v.alias("_x"))
    d = d if by else d.withColumn("_k", F.lit(0))
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"),
                              F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    st = st.filter((F.col("_n") >= 2) & (F.col("_sd") > 0)) \
        .withColumn("_h", F.lit(bw_adjust) * F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    glo = F.col("_mn") - cut * F.col("_h")
    ghi = F.col("_mx") + cut * F.col("_h")
    if clip is not None:
        glo = F.greatest(glo, F.lit(float(clip[0])))
        ghi = F.least(ghi, F.lit(float(clip[1])))
    st = st.select(*keys, "_n", "_h", glo.alias("_glo"), ghi.alias("_ghi"))
    st = st if wide else few(st)

    def at(j):
        return F.col("_glo") + j * (F.col("_ghi") - F.col("_glo")) / (grid_size - 1)

    def kernel(j):
        z = (at(j) - F.col("_x")) / F.col("_h")
        return F.sum(F.exp(-0.5 * z * z)).alias(f"_s{j}")

    sums = d.join(st, keys).groupBy(*keys, "_n", "_h", "_glo", "_ghi").agg(*[kernel(j) for j in range(grid_size)])
    points = F.posexplode(F.array(*[f"_s{j}" for j in range(grid_size)])).alias("j", "_s")
    long = sums.select(*keys, "_n", "_h", "_glo", "_ghi", points)
    return long.select(*by, "j", at(F.col("j")).alias("x"), (F.col("_s") / (F.col("_n") * F.col("_h") * SQRT_2PI)).alias("density"))


_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_summary(df: DataFrame, value: str, by: Sequence[str], whisker: float = 1.5,
                method: str = "exact", wide: bool = False) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the fences),
    outlier count and mean per group."""
    by = list(by)
    d = _clean(df, value, by)
    q = group_quantiles_wide(d, value, _QUARTILES, by, method, wide)
    j = d.join(q if wide else few(q), by)
    x = F.col(value).cast("double")
    reach = whisker * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return j.groupBy(*by, *_QUARTILES).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(F.when(inside, x)).alias("whisker_lo"),
        F.max(F.when(inside, x)).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))


def violin_table(df: DataFrame, value: str, by: Sequence[str], wide: bool = False, **kw) -> DataFrame:
    """A26 + A28 for a violin plot: the density grid of each group with its quartiles
    (by..., j, x, density, q1, median, q3); keywords as in ``kde``."""
    by = list(by)
    q = group_quantiles_wide(_clean(df, value, by), value, _QUARTILES, by, wide=wide)
    return kde(df, value, by, wide=wide, **kw).join(q, by)


def linear_trend(series: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """A29 + W6: least squares of y on the 0-based ordinal position of x
    (numpy polyfit(arange(n), y, 1)); returns the series with pos, slope,
    intercept and fitted value.  Runs on an aggregated series."""
    by = list(by)
    s = ordinal_position(series.filter(F.col(y).isNotNull()), x, by, "pos")
    # the fit is a window aggregate over each (aggregated) series: one pass,
    # no second copy of the series plan
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    pos = F.col("pos").cast("double")
    return (s.withColumn("slope", F.regr_slope(F.col(y), pos).over(w))
            .withColumn("intercept", F.regr_intercept(F.col(y), pos).over(w))
            .withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("pos")))
