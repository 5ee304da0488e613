"""Classification queries (C1-C5), cumulative share (W5), near pairs (J7), match rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import labels as L
from ..operators import aggregate as A
from ..operators import classify as C
from ..operators import joins as J
from ..operators import windows as WN
from .common import M, T
from .registry import query, r6


@query("reliability_matrix", extra_ctes="""
d1 AS (SELECT * FROM (VALUES ('Diferente'), ('Igual')) t(label_cpf)),
d2 AS (SELECT * FROM (VALUES ('< 85%'), ('>= 85%')) t(label_geo)),
c AS (SELECT label_cpf, CASE WHEN indice >= 0.85 THEN '>= 85%' ELSE '< 85%' END AS label_geo, count(*) AS n
      FROM matches WHERE label_cpf IS NOT NULL GROUP BY 1, 2),
f AS (SELECT d1.label_cpf, d2.label_geo, coalesce(c.n, 0) AS n FROM d1 CROSS JOIN d2
      LEFT JOIN c ON c.label_cpf = d1.label_cpf AND c.label_geo = d2.label_geo)""", sql="""
SELECT label_cpf, label_geo, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
       CASE label_cpf || '|' || label_geo
         WHEN 'Igual|>= 85%' THEN 'MATURIDADE ALTA' || chr(10) || '(Monitorar)'
         WHEN 'Igual|< 85%' THEN 'ERRO TÉCNICO' || chr(10) || '(Retificar)'
         WHEN 'Diferente|>= 85%' THEN 'RISCO JURÍDICO' || chr(10) || '(Auditar)'
         WHEN 'Diferente|< 85%' THEN 'CRÍTICO/BAIXA PRIOR.' || chr(10) || '(Reestruturar)' END AS acao,
       CASE label_cpf || '|' || label_geo
         WHEN 'Igual|>= 85%' THEN 'ALTA MATURIDADE' || chr(10) || '(Monitorar)'
         WHEN 'Igual|< 85%' THEN 'DESAFIO ESPACIAL' || chr(10) || '(Retificar/Notificar)'
         WHEN 'Diferente|>= 85%' THEN 'DESAFIO CADASTRAL' || chr(10) || '(Auditar)'
         WHEN 'Diferente|< 85%' THEN 'BAIXA MATURIDADE' || chr(10) || '(Reestruturar)' END AS acao_analise,
       CASE WHEN n > 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n > 1000 THEN printf('%.0fK', n / 1000.0)
            ELSE printf('%.0f', CAST(n AS DOUBLE)) END AS n_txt
FROM f
""")
def reliability_matrix(spark, sf):
    """Owner x high-index matrix with recommended actions."""
    r = C.reliability_matrix(M(spark, sf))
    return r.select("label_cpf", "label_geo", F.col("n").cast("long"), r6("pct"), "acao", "acao_analise", "n_txt")


@query("risk_matrix", extra_ctes="""
d1 AS (SELECT * FROM (VALUES ('Diferente'), ('Igual')) t(label_cpf)),
d2 AS (SELECT * FROM (VALUES ('0-20%'), ('20-40%'), ('40-60%'), ('60-80%'), ('80-100%')) t(faixa_risco)),
c AS (SELECT label_cpf, CASE WHEN indice >= 0 AND indice <= 0.2 THEN '0-20%' WHEN indice > 0.2 AND indice <= 0.4 THEN '20-40%'
            WHEN indice > 0.4 AND indice <= 0.6 THEN '40-60%' WHEN indice > 0.6 AND indice <= 0.8 THEN '60-80%'
            WHEN indice > 0.8 AND indice <= 1.0 THEN '80-100%' END AS faixa_risco, count(*) AS n
      FROM matches WHERE indice IS NOT NULL AND label_cpf IS NOT NULL GROUP BY 1, 2),
f AS (SELECT d1.label_cpf, d2.faixa_risco, coalesce(c.n, 0) AS n FROM d1 CROSS JOIN d2
      LEFT JOIN c ON c.label_cpf = d1.label_cpf AND c.faixa_risco = d2.faixa_risco)""", sql="""
SELECT label_cpf, faixa_risco, CAST(n AS BIGINT) AS n,
       round(CASE WHEN sum(n) OVER (PARTITION BY faixa_risco) > 0
                  THEN n * 100.0 / sum(n) OVER (PARTITION BY faixa_risco) ELSE 0 END, 6) AS pct_col,
       CAST(sum(n) OVER (PARTITION BY faixa_risco) AS BIGINT) AS col_total,
       round(sum(n) OVER (PARTITION BY faixa_risco) * 100.0 / sum(n) OVER (), 6) AS col_share,
       CAST(sum(n) OVER (PARTITION BY label_cpf) AS BIGINT) AS row_total,
       round(sum(n) OVER (PARTITION BY label_cpf) * 100.0 / sum(n) OVER (), 6) AS row_share
FROM f
""")
def risk_matrix(spark, sf):
    """Owner x five index bands, column percentages and margins."""
    r = C.risk_matrix(M(spark, sf))
    return r.select("label_cpf", "faixa_risco", F.col("n").cast("long"), r6("pct_col"),
                    F.col("col_total").cast("long"), r6("col_share"), F.col("row_total").cast("long"),
                    r6("row_share"))


@query("maturity_matrix", extra_ctes="s AS (" + """
SELECT estado, avg(CASE WHEN indice >= 0.85 THEN 1.0 ELSE 0.0 END) * 100 AS x, avg(cpf_ok) * 100 AS y,
       min(regiao) AS regiao, count(*) AS n FROM matches WHERE estado IS NOT NULL GROUP BY 1)""", sql="""
SELECT estado, round(x, 6) AS pct_espacial_bom, round(y, 6) AS pct_cpf_igual, regiao, CAST(n AS BIGINT) AS total_cars,
       round(CASE WHEN max(n) OVER () = min(n) OVER () THEN 100.0
                  ELSE (n - min(n) OVER ()) * 1.0 / (max(n) OVER () - min(n) OVER ()) * 700 + 100 END, 6) AS bubble_size,
       CASE WHEN x >= 50 AND y >= 50 THEN 'ALTA MATURIDADE' WHEN x < 50 AND y >= 50 THEN 'DESAFIO ESPACIAL'
            WHEN x >= 50 AND y < 50 THEN 'DESAFIO CADASTRAL' ELSE 'BAIXA MATURIDADE' END AS quadrante
FROM s
""")
def maturity_matrix(spark, sf):
    """Maturity scatter table per state with bubble sizes and quadrants."""
    r = C.maturity_matrix(M(spark, sf), ["estado"])
    return r.select("estado", r6("pct_espacial_bom"), r6("pct_cpf_igual"), "regiao",
                    F.col("total_cars").cast("long"), r6("bubble_size"), "quadrante")


@query("area_agreement", extra_ctes="""
b AS (SELECT CASE WHEN discrepancia <= -10 THEN 'Car < Sigef' || chr(10) || '(> -10%)'
            WHEN discrepancia > -10 AND discrepancia <= -1 THEN 'Car < Sigef' || chr(10) || '(-1% a -10%)'
            WHEN discrepancia > -1 AND discrepancia <= 1 THEN 'Exato' || chr(10) || '(± 1%)'
            WHEN discrepancia > 1 AND discrepancia <= 10 THEN 'Car > Sigef' || chr(10) || '(+1% a +10%)'
            WHEN discrepancia > 10 THEN 'Car > Sigef' || chr(10) || '(> +10%)' END AS faixa,
            CASE WHEN discrepancia BETWEEN -10 AND 10 THEN 'Preciso' WHEN discrepancia > 10 THEN 'Superestimado (CAR > SIGEF)'
            WHEN discrepancia < -10 THEN 'Subestimado (CAR < SIGEF)' END AS status_area FROM matches),
c AS (SELECT 'faixa' AS kind, faixa AS label, count(*) AS n FROM b WHERE faixa IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'status', status_area, count(*) FROM b WHERE status_area IS NOT NULL GROUP BY 2)""", sql="""
SELECT kind, label, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (PARTITION BY kind), 6) AS pct FROM c
""")
def area_agreement(spark, sf):
    """Area-agreement distribution by discrepancy band and tolerance class."""
    r = C.area_agreement(M(spark, sf))
    return r.select("kind", "label", F.col("n").cast("long"), r6("pct"))


@query("cumulative_share", extra_ctes="""
c AS (SELECT faixa_jaccard, count(*) AS n FROM matches WHERE faixa_jaccard IS NOT NULL GROUP BY 1),
s AS (SELECT faixa_jaccard, n * 100.0 / sum(n) OVER () AS share FROM c)""", sql="""
SELECT faixa_jaccard, round(share, 6) AS share,
       round(coalesce(sum(share) OVER (ORDER BY faixa_jaccard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + 2.0 * (row_number() OVER (ORDER BY faixa_jaccard) - 1), 6) AS "offset",
       round(coalesce(sum(share) OVER (ORDER BY faixa_jaccard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + 2.0 * (row_number() OVER (ORDER BY faixa_jaccard) - 1) + share / 2, 6) AS centre
FROM s
""")
def cumulative_share(spark, sf):
    """Share, running offset (with a gap of 2 between cells) and centre per band."""
    f = A.freq_share(M(spark, sf), "faixa_jaccard", "n", "share")
    f = f.withColumn("_ord", X.band_ordinal("faixa_jaccard", L.JACCARD_LABELS))
    c = WN.cumulative_share(f, "_ord", "share", gap=2.0)
    return c.select("faixa_jaccard", r6("share"), r6("offset"), r6("centre"))


_SCORE = """
s AS (SELECT estado, avg(CASE WHEN indice >= 0.85 THEN 1.0 ELSE 0.0 END) * 100 AS x, avg(cpf_ok) * 100 AS y
      FROM matches WHERE estado IS NOT NULL GROUP BY 1)"""


@query("near_pairs", extra_ctes=_SCORE, sql="""
SELECT a.estado AS estado_1, b.estado AS estado_2,
       round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
FROM s a JOIN s b ON a.estado < b.estado
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1.5 * 1.5
""")
def near_pairs(spark, sf):
    """Pairs of states whose (% high index, % owner equal) points lie closer than 1.5."""
    s = A.area_scorecard(M(spark, sf), ["estado"])
    p = J.pairs_within(s, "estado", "pct_espacial_bom", "pct_cpf_igual", 1.5)
    return p.select(F.col("estado_1"), F.col("estado_2"), r6("distance"))


@query("two_way_match", extra_ctes="""
cn AS (SELECT c_custkey, n_name AS estado FROM customer JOIN nation ON c_nationkey = n_nationkey),
fa AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
ra AS (SELECT estado, avg(CASE WHEN fa.o_custkey IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100 AS pct_car_com_match,
              count(*) AS n_a FROM cn LEFT JOIN fa ON cn.c_custkey = fa.o_custkey GROUP BY 1),
li AS (SELECT DISTINCT l_orderkey FROM lineitem),
ob AS (SELECT o_orderkey, estado FROM orders JOIN cn ON o_custkey = c_custkey),
rb AS (SELECT estado, avg(CASE WHEN li.l_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100 AS pct_sncr_com_match,
              count(*) AS n_b FROM ob LEFT JOIN li ON ob.o_orderkey = li.l_orderkey GROUP BY 1)""", sql="""
SELECT coalesce(ra.estado, rb.estado) AS estado, round(pct_car_com_match, 6) AS pct_car_com_match,
       round(pct_sncr_com_match, 6) AS pct_sncr_com_match, CAST(n_a AS BIGINT) AS total_imoveis_car,
       CASE WHEN pct_car_com_match >= 50 AND pct_sncr_com_match >= 50 THEN 'CONSOLIDADO'
            WHEN pct_car_com_match < 50 AND pct_sncr_com_match >= 50 THEN 'INFORMALIDADE FUNDIÁRIA'
            WHEN pct_car_com_match >= 50 AND pct_sncr_com_match < 50 THEN 'PASSIVO AMBIENTAL'
            WHEN pct_car_com_match < 50 AND pct_sncr_com_match < 50 THEN 'DADOS ISOLADOS' END AS quadrante
FROM ra FULL OUTER JOIN rb ON ra.estado = rb.estado
""")
def two_way_match(spark, sf):
    """A31 + C4: per state, share of registry-A entities matched in B and of B
    entities matched in A, and the integration quadrant."""
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("estado"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "estado")
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = T(spark, sf, "lineitem").select("l_orderkey")
    rate_a = A.match_rate(cn, "c_custkey", "estado",
                          o.filter(F.col("o_orderstatus") == "F").select("o_custkey"), "pct_car_com_match")
    ob = o.join(cn, o.o_custkey == cn.c_custkey).select("o_orderkey", "estado")
    rate_b = A.match_rate(ob, "o_orderkey", "estado", li, "pct_sncr_com_match")
    r = C.integration_quadrants(A.two_way_match(rate_a, rate_b, "estado"), "pct_car_com_match",
                                "pct_sncr_com_match")
    return r.select("estado", r6("pct_car_com_match"), r6("pct_sncr_com_match"),
                    F.col("n_pct_car_com_match").cast("long").alias("total_imoveis_car"), "quadrante")
