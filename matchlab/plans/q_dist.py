"""Distribution queries: profiles (A17-A20), quantiles (A23), box (A28),
histogram (A27), kernel density (A26), linear trend (A29, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import distribution as D
from .common import M
from .registry import query, r6


def r4(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 4).alias(name or c)


_NUM = ["indice", "area_a", "area_b", "discrepancia", "num_modulo"]


@query("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max "
    f"FROM matches WHERE {c} IS NOT NULL" for c in _NUM))
def numeric_profile(spark, sf):
    """Mean, exact median, sample std, min, max of every numeric column."""
    p = A.numeric_profile(M(spark, sf), _NUM)
    return p.select(F.col("column").alias("column_name"), r4("mean"), r4("median"), r4("std"), r4("min"), r4("max"))


_DESC = ["indice", "area_a", "discrepancia"]


@query("describe_quartiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
    f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max "
    f"FROM matches" for c in _DESC))
def describe_quartiles(spark, sf):
    """Count, mean, std, min, quartiles, max per column (long form)."""
    p = A.describe_quartiles(M(spark, sf), _DESC)
    return p.select(F.col("column").alias("column_name"), F.col("count").cast("long"), r4("mean"), r4("std"),
                    r4("min"), r4("p25"), r4("p50"), r4("p75"), r4("max"))


@query("group_profile", """
SELECT class_tam_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(indice), 6) AS mean, round(median(indice), 6) AS median,
       round(stddev_pop(indice), 6) AS std, round(min(indice), 6) AS min, round(max(indice), 6) AS max
FROM matches WHERE class_tam_imovel IS NOT NULL AND indice IS NOT NULL GROUP BY 1
""")
def group_profile(spark, sf):
    """Per-group n, mean, median, population std, min, max."""
    p = A.group_profile(M(spark, sf), "class_tam_imovel", "indice")
    return p.select("class_tam_imovel", F.col("n").cast("long"), r6("mean"), r6("median"), r6("std"),
                    r6("min"), r6("max"))


_CAT = ["regiao", "class_tam_imovel", "status_imovel", "label_cpf", "faixa_jaccard"]


@query("categorical_profile", extra_ctes="c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM matches "
    f"WHERE {c} IS NOT NULL GROUP BY 2" for c in _CAT) + ")", sql="""
SELECT column_name, value, CAST(n AS BIGINT) AS n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY column_name), 6) AS pct FROM c
""")
def categorical_profile(spark, sf):
    """Value, count and share of every categorical column."""
    p = A.categorical_profile(M(spark, sf), _CAT)
    return p.select(F.col("column").alias("column_name"), "value", F.col("n").cast("long"), r6("pct"))


@query("quantile_legend", """
SELECT regiao, round(quantile_cont(indice, 0.0), 6) AS q_min, round(median(indice), 6) AS q_mid,
       round(quantile_cont(indice, 1.0), 6) AS q_max
FROM matches WHERE regiao IS NOT NULL AND indice IS NOT NULL GROUP BY 1
""")
def quantile_legend(spark, sf):
    """Min / median / max legend values per region (exact)."""
    q = A.legend_quantiles(M(spark, sf), "indice", ["regiao"])
    return q.select("regiao", r6("q_min"), r6("q_mid"), r6("q_max"))


@query("box_summary", extra_ctes="""
v AS (SELECT class_tam_imovel, discrepancia AS x FROM matches WHERE class_tam_imovel IS NOT NULL AND discrepancia IS NOT NULL),
q AS (SELECT class_tam_imovel, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3
      FROM v GROUP BY 1)""", sql="""
SELECT q.class_tam_imovel, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS mean,
       round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_lo,
       round(max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM v JOIN q USING (class_tam_imovel) GROUP BY q.class_tam_imovel, q1, med, q3
""")
def box_summary(spark, sf):
    """Box-plot table of the area discrepancy per size class."""
    b = D.box_summary(M(spark, sf), "discrepancia", ["class_tam_imovel"])
    return b.select("class_tam_imovel", r4("q1"), r4("median"), r4("q3"), F.col("n").cast("long"), r4("mean"),
                    r4("whisker_lo"), r4("whisker_hi"), F.col("n_outliers").cast("long"))


@query("histogram", extra_ctes="""
v AS (SELECT indice * 100 AS x FROM matches WHERE indice IS NOT NULL),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN mm.hi = mm.lo THEN 0 ELSE least(floor((x - mm.lo) / (mm.hi - mm.lo) * 20), 19) END AS INT) AS bin,
             count(*) AS n FROM v, mm GROUP BY 1)""", sql="""
SELECT CAST(r.range AS INT) AS bin, round(mm.lo + r.range * (mm.hi - mm.lo) / 20, 6) AS bin_lo,
       round(mm.lo + (r.range + 1) * (mm.hi - mm.lo) / 20, 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(20) r CROSS JOIN mm LEFT JOIN c ON c.bin = r.range
""")
def histogram(spark, sf):
    """20 equal-width bins of the index in percent, empty bins kept."""
    m = M(spark, sf).select((F.col("indice") * 100).alias("pct"))
    h = D.histogram(m, "pct", 20)
    return h.select(F.col("bin").cast("int"), r6("bin_lo"), r6("bin_hi"), F.col("n").cast("long"))


_KDE_CTES = """
v AS (SELECT class_tam_imovel AS g, indice * 100 AS x FROM matches WHERE indice IS NOT NULL AND NOT isnan(indice)
      AND class_tam_imovel IS NOT NULL),
st AS (SELECT g, count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v GROUP BY 1
       HAVING count(*) >= 2 AND stddev_samp(x) > 0),
st2 AS (SELECT *, sd * pow(n, -0.2) AS h FROM st),
st3 AS (SELECT *, greatest(mn - 3.0 * h, 0.0) AS glo, least(mx + 3.0 * h, 100.0) AS ghi FROM st2),
pts AS (SELECT g, x AS p, count(*) AS c FROM v GROUP BY 1, 2),
grid AS (SELECT st3.g, st3.n, st3.h, r.range AS j, st3.glo + r.range * (st3.ghi - st3.glo) / 49 AS x
         FROM st3 CROSS JOIN range(50) r)"""


@query("kde_by_group", extra_ctes=_KDE_CTES, sql="""
SELECT grid.g AS class_tam_imovel, CAST(grid.j AS INT) AS j, round(grid.x, 6) AS x,
       round(sum(pts.c * exp(-0.5 * ((grid.x - pts.p) / grid.h) * ((grid.x - pts.p) / grid.h)))
             / (grid.n * grid.h * sqrt(2 * pi())), 6) AS density
FROM grid JOIN pts ON grid.g = pts.g GROUP BY grid.g, grid.j, grid.x, grid.n, grid.h
""")
def kde_by_group(spark, sf):
    """Per-size-class Gaussian KDE of the index (percent), each class
    normalised alone, grid clipped to [0, 100]."""
    m = M(spark, sf).select("class_tam_imovel", (F.col("indice") * 100).alias("pct"))
    k = D.kde(m, "pct", ["class_tam_imovel"], grid_size=50, clip=(0.0, 100.0))
    return k.select("class_tam_imovel", F.col("j").cast("int"), r6("x"), r6("density"))


@query("violin_table", extra_ctes=_KDE_CTES + """,
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)""", sql="""
SELECT grid.g AS class_tam_imovel, CAST(grid.j AS INT) AS j, round(grid.x, 6) AS x,
       round(sum(pts.c * exp(-0.5 * ((grid.x - pts.p) / grid.h) * ((grid.x - pts.p) / grid.h)))
             / (grid.n * grid.h * sqrt(2 * pi())), 6) AS density, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3
FROM grid JOIN pts ON grid.g = pts.g JOIN q ON q.g = grid.g GROUP BY grid.g, grid.j, grid.x, grid.n, grid.h, q1, med, q3
""")
def violin_table(spark, sf):
    """A26 + A28: density and quartiles of the index (percent) per size class."""
    m = M(spark, sf).select("class_tam_imovel", (F.col("indice") * 100).alias("pct"))
    k = D.violin_table(m, "pct", ["class_tam_imovel"], grid_size=50, clip=(0.0, 100.0))
    return k.select("class_tam_imovel", F.col("j").cast("int"), r6("x"), r6("density"), r6("q1"), r6("median"), r6("q3"))


@query("linear_trend", extra_ctes="""
s AS (SELECT ano_cadastro, median(indice) AS y FROM matches WHERE ano_cadastro IS NOT NULL GROUP BY 1),
p AS (SELECT ano_cadastro, y, CAST(row_number() OVER (ORDER BY ano_cadastro) - 1 AS INT) AS pos FROM s)""", sql="""
SELECT ano_cadastro, pos, round(y, 6) AS value, round(regr_slope(y, pos) OVER (), 6) AS slope,
       round(regr_intercept(y, pos) OVER (), 6) AS intercept,
       round(regr_intercept(y, pos) OVER () + regr_slope(y, pos) OVER () * pos, 6) AS fitted
FROM p
""")
def linear_trend(spark, sf):
    """A29 + W6: least-squares trend of the yearly median index over period position."""
    s = A.series_agg(M(spark, sf), "ano_cadastro", "indice", "median")
    t = D.linear_trend(s, "ano_cadastro", "value")
    return t.select("ano_cadastro", F.col("pos").cast("int"), r6("value"), r6("slope"), r6("intercept"),
                    r6("fitted"))


@query("kde_overall", extra_ctes="""
v AS (SELECT discrepancia AS x FROM matches WHERE discrepancia BETWEEN -100 AND 100 AND NOT isnan(discrepancia)),
st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v),
st2 AS (SELECT *, sd * pow(n, -0.2) AS h FROM st WHERE n >= 2 AND sd > 0),
st3 AS (SELECT *, mn - 3.0 * h AS glo, mx + 3.0 * h AS ghi FROM st2),
pts AS (SELECT x AS p, count(*) AS c FROM v GROUP BY 1),
grid AS (SELECT st3.n, st3.h, r.range AS j, st3.glo + r.range * (st3.ghi - st3.glo) / 49 AS x
         FROM st3 CROSS JOIN range(50) r)""", sql="""
SELECT CAST(grid.j AS INT) AS j, round(grid.x, 6) AS x,
       round(sum(pts.c * exp(-0.5 * ((grid.x - pts.p) / grid.h) * ((grid.x - pts.p) / grid.h)))
             / (grid.n * grid.h * sqrt(2 * pi())), 8) AS density
FROM grid CROSS JOIN pts GROUP BY grid.j, grid.x, grid.n, grid.h
""")
def kde_overall(spark, sf):
    """A26 ungrouped variant: density of the area discrepancy restricted to [-100, 100]."""
    m = M(spark, sf).filter(F.col("discrepancia").between(-100.0, 100.0))
    k = D.kde(m, "discrepancia", [], grid_size=50)
    return k.select(F.col("j").cast("int"), r6("x"), F.round("density", 8).alias("density"))
