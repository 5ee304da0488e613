"""Rank-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ranks
from ..operators import ranktests as RT
from .common import M
from .registry import query, r6

_V = """
v AS (SELECT class_tam_imovel AS g, indice AS x FROM matches
      WHERE class_tam_imovel IS NOT NULL AND indice IS NOT NULL AND NOT isnan(indice))"""


@query("average_ranks", """
SELECT indice AS value, CAST(count(*) AS BIGINT) AS cnt,
       round(sum(count(*)) OVER (ORDER BY indice) - count(*) + (count(*) + 1) / 2.0, 6) AS rank
FROM matches WHERE indice IS NOT NULL GROUP BY indice
""")
def average_ranks(spark, sf):
    """Average (tie) rank of every distinct index value over the whole table."""
    r = ranks.average_ranks(M(spark, sf), "indice")
    return r.select(F.col("indice").alias("value"), F.col("cnt").cast("long"), r6("rank"))


_KW_CTES = _V + """,
rk AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v),
rs AS (SELECT g, sum(r) AS rr, count(*) AS n FROM rk GROUP BY g),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS nn, count(DISTINCT g) AS k FROM v),
ties AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS tt FROM (SELECT count(*) AS t FROM v GROUP BY x)),
hh AS (SELECT (12.0 / (nn * (nn + 1)) * sum(rr * rr / n) - 3 * (nn + 1)) / (1 - tt / (nn * nn * nn - nn)) AS h, nn, k
       FROM rs, tot, ties GROUP BY nn, k, tt)"""


@query("kruskal_wallis", extra_ctes=_KW_CTES, sql="""
SELECT round(h, 6) AS h, CAST(k - 1 AS BIGINT) AS dof, round(greatest(0, (h - k + 1) / (nn - k)), 6) AS epsilon2,
       round(h / (nn - 1), 6) AS eta2,
       CASE WHEN greatest(0, (h - k + 1) / (nn - k)) < 0.01 THEN 'Desprezível'
            WHEN greatest(0, (h - k + 1) / (nn - k)) < 0.06 THEN 'Pequeno'
            WHEN greatest(0, (h - k + 1) / (nn - k)) < 0.14 THEN 'Médio' ELSE 'Grande' END AS magnitude,
       CAST(nn AS BIGINT) AS n, CAST(k AS BIGINT) AS k
FROM hh
""")
def kruskal_wallis(spark, sf):
    """K1 + K2: Kruskal-Wallis H of the index across size classes, effect sizes."""
    kw = RT.kruskal_wallis(M(spark, sf), "class_tam_imovel", "indice")
    return kw.select(r6("h"), "dof", r6("epsilon2"), r6("eta2"), "magnitude", "n", "k")


@query("kruskal_test", extra_ctes=_KW_CTES, sql="""
SELECT round(h, 6) AS h, CAST(k - 1 AS BIGINT) AS dof, round(exp(-h / 2), 9) AS p_value, exp(-h / 2) < 0.05 AS diferenca_global
FROM hh
""")
def kruskal_test(spark, sf):
    """K1 with the chi-square p-value; with three groups it is exp(-h / 2)."""
    t = RT.kruskal_test(M(spark, sf), "class_tam_imovel", "indice")
    return t.select(r6("h"), "dof", F.round("p_value", 9).alias("p_value"), "diferenca_global")


_MW_CTES = """
pairs AS (SELECT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM v) a JOIN (SELECT DISTINCT g FROM v) b ON a.g < b.g),
pv AS (SELECT p.g1, p.g2, v.g, v.x FROM pairs p JOIN v ON v.g = p.g1 OR v.g = p.g2),
rk AS (SELECT g1, g2, g, rank() OVER (PARTITION BY g1, g2 ORDER BY x) + (count(*) OVER (PARTITION BY g1, g2, x) - 1) / 2.0 AS r
       FROM pv),
s AS (SELECT g1, g2, sum(CASE WHEN g = g1 THEN r END) AS r1, count_if(g = g1) AS n1, count_if(g = g2) AS n2
      FROM rk GROUP BY 1, 2),
med AS (SELECT g, median(x) AS m FROM v GROUP BY g)"""


@query("mannwhitney_pairs", extra_ctes=_V + "," + _MW_CTES, sql="""
SELECT s.g1 AS grupo_1, s.g2 AS grupo_2, round(r1 - n1 * (n1 + 1) / 2.0, 6) AS u,
       CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(1 - 2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2), 6) AS r_effect,
       round(m1.m - m2.m, 6) AS delta_mediana
FROM s JOIN med m1 ON m1.g = s.g1 JOIN med m2 ON m2.g = s.g2
""")
def mannwhitney_pairs(spark, sf):
    """K3: pairwise Mann-Whitney U, rank-biserial r, median difference (size classes)."""
    mw = RT.mann_whitney_pairs(M(spark, sf), "class_tam_imovel", "indice")
    return mw.select("grupo_1", "grupo_2", r6("u"), F.col("n1").cast("long"), F.col("n2").cast("long"),
                     r6("r_effect"), r6("delta_mediana"))


# The tail of the normal distribution is its density summed over range (Simpson, z to z + 12).
_P_NORMAL = _MW_CTES + """,
t AS (SELECT g1, g2, sum(CAST(c AS DOUBLE) * c * c - c) AS tt FROM (SELECT g1, g2, count(*) AS c FROM pv GROUP BY g1, g2, x) GROUP BY 1, 2),
zz AS (SELECT s.*, r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 AS DOUBLE) * n2 / 2 AS mu,
              sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - tt / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS sd
       FROM s JOIN t ON s.g1 = t.g1 AND s.g2 = t.g2),
pn AS (SELECT g1, g2, n1, n2, u, greatest(0, abs(u - mu) - 0.5) / sd AS z FROM zz),
pp AS (SELECT g1, g2, n1, n2, u, least(1, 2 / sqrt(2 * pi()) * sum(
         (CASE WHEN k IN (0, 2400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z + k * 0.005) * (z + k * 0.005) / 2)) * 0.005 / 3) AS p
       FROM pn, range(0, 2401) AS r(k) GROUP BY g1, g2, n1, n2, u)"""

# All arrangements of n1 among n1 + n2 ranks as bit masks, by their U.
_P_EXACT = _MW_CTES + """,
us AS (SELECT *, CAST(r1 - n1 * (n1 + 1) / 2.0 AS BIGINT) AS u FROM s),
kinds AS (SELECT DISTINCT n1, n2 FROM us),
masks AS (SELECT n1, n2, list_sum(list_transform(range(0, CAST(n1 + n2 AS BIGINT)), lambda b: CASE WHEN (m >> CAST(b AS INT)) & 1 = 1 THEN b ELSE 0 END)) - n1 * (n1 - 1) // 2 AS mu
          FROM kinds, unnest(range(0, CAST(pow(2, n1 + n2) AS BIGINT))) AS t(m) WHERE bit_count(m) = n1),
dist AS (SELECT n1, n2, mu, sum(count(*)) OVER (PARTITION BY n1, n2 ORDER BY mu) / sum(count(*)) OVER (PARTITION BY n1, n2) AS upto
         FROM masks GROUP BY n1, n2, mu),
pp AS (SELECT g1, g2, us.n1, us.n2, u, least(1, 2 * upto) AS p
       FROM us JOIN dist d ON d.n1 = us.n1 AND d.n2 = us.n2 AND d.mu = least(u, us.n1 * us.n2 - u))"""


def _tests_sql(alpha: str) -> str:
    return f"""
SELECT pp.g1 AS grupo_1, pp.g2 AS grupo_2, round(CAST(u AS DOUBLE), 6) AS u, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(1 - 2 * u / (n1 * n2), 6) AS r_effect, round(m1.m - m2.m, 6) AS delta_mediana, round(p, 9) AS p_value,
       round(CAST({alpha} AS DOUBLE), 9) AS alpha_corrigido, p < {alpha} AS significativo, CAST(count_if(p < {alpha}) OVER () AS BIGINT) AS n_significativos,
       CASE WHEN m1.m - m2.m > 0 THEN '>' ELSE '<' END AS direcao
FROM (SELECT *, count(*) OVER () AS k FROM pp) pp JOIN med m1 ON m1.g = pp.g1 JOIN med m2 ON m2.g = pp.g2
"""


def _tests(df, group, value, correction):
    t = RT.mann_whitney_tests(df, group, value, correction=correction)
    return t.select("grupo_1", "grupo_2", r6("u"), F.col("n1").cast("long"), F.col("n2").cast("long"), r6("r_effect"), r6("delta_mediana"),
                    F.round("p_value", 9).alias("p_value"), F.round("alpha_corrigido", 9).alias("alpha_corrigido"), "significativo",
                    F.col("n_significativos").cast("long"), "direcao")


@query("mannwhitney_tests", extra_ctes=_V + "," + _P_NORMAL, sql=_tests_sql("0.05 / k"))
def mannwhitney_tests(spark, sf):
    """K3 + K4: p-values, Bonferroni-corrected alpha, significance flags and direction."""
    return _tests(M(spark, sf), "class_tam_imovel", "indice", "bonferroni")


@query("mannwhitney_sidak", extra_ctes=_V.replace("class_tam_imovel", "regiao") + "," + _P_NORMAL, sql=_tests_sql("(1 - pow(0.95, 1.0 / k))"))
def mannwhitney_sidak(spark, sf):
    """K4: the Sidak correction, across regions."""
    return _tests(M(spark, sf), "regiao", "indice", "sidak")


@query("mannwhitney_uncorrected", extra_ctes=_V.replace("class_tam_imovel", "status_imovel") + "," + _P_NORMAL, sql=_tests_sql("0.05"))
def mannwhitney_uncorrected(spark, sf):
    """K4: no correction, across registration statuses."""
    return _tests(M(spark, sf), "status_imovel", "indice", "none")


@query("mannwhitney_small", extra_ctes="""
v AS (SELECT estado AS g, avg(indice) AS x FROM matches WHERE ano_cadastro IS NOT NULL AND indice IS NOT NULL GROUP BY estado, ano_cadastro),""" + _P_EXACT,
       sql=_tests_sql("0.05 / k"))
def mannwhitney_small(spark, sf):
    """K3 for small samples without ties (the yearly means of every two states): exact p-values."""
    m = M(spark, sf).where("ano_cadastro IS NOT NULL AND indice IS NOT NULL")
    return _tests(m.groupBy("estado", "ano_cadastro").agg(F.avg("indice").alias("media")), "estado", "media", "bonferroni")


@query("group_pairs", """
SELECT a.estado AS grupo_1, b.estado AS grupo_2 FROM (SELECT DISTINCT estado FROM matches WHERE estado IS NOT NULL) a
JOIN (SELECT DISTINCT estado FROM matches WHERE estado IS NOT NULL) b ON a.estado < b.estado
""")
def group_pairs(spark, sf):
    """All unordered pairs of the distinct groups (C(k, 2) rows)."""
    return J.group_pairs(M(spark, sf), "estado")
