"""Grouped tables, joins, contingency and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import labels as L
from ..operators import aggregate as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import sketches as SK
from ..operators import topk as TK
from ..operators import windows as WN
from .common import M, T, property_sketches
from .registry import query, r6

# --- totals enrichment (J3, A2, A21) ---------------------------------------------------

_TOTALS_CTE = """
tot_mun AS (SELECT o_custkey AS idt_municipio, CAST(year(o_orderdate) AS INT) AS ano_cadastro,
                   count(DISTINCT o_orderkey) AS total_cars_municipio FROM orders GROUP BY 1, 2),
tot_uf AS (SELECT n_name AS estado, CAST(year(o_orderdate) AS INT) AS ano_cadastro,
                  count(DISTINCT o_orderkey) AS total_cars_cadastrados
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
enriched AS (SELECT m.*, tm.total_cars_municipio, tu.total_cars_cadastrados FROM matches m
             LEFT JOIN tot_mun tm ON m.idt_municipio = tm.idt_municipio AND m.ano_cadastro = tm.ano_cadastro
             LEFT JOIN tot_uf tu ON m.estado = tu.estado AND m.ano_cadastro = tu.ano_cadastro)"""


def place_year_totals_table(spark, sf):
    """A2: distinct registrations per (place, year) from the registration events."""
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("idt_municipio"),
                                      X.year_of("o_orderdate").alias("ano_cadastro"), "o_orderkey")
    return A.distinct_count(o, "o_orderkey", ["idt_municipio", "ano_cadastro"], "total_cars_municipio")


def state_year_totals_table(spark, sf):
    """A2 at state grain: distinct registrations per (state, year)."""
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey", X.year_of("o_orderdate").alias("ano_cadastro"))
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("estado"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.distinct_count(j, "o_orderkey", ["estado", "ano_cadastro"], "total_cars_cadastrados")


def enriched(spark, sf):
    """The fact table with per-(place, year) and per-(state, year) totals attached."""
    m = M(spark, sf)
    m = m.drop(*[c for c in ("total_cars_municipio", "total_cars_cadastrados") if c in m.columns])  # Q13
    e = J.left_join_fill(m, place_year_totals_table(spark, sf), ["idt_municipio", "ano_cadastro"])
    return J.left_join_fill(e, state_year_totals_table(spark, sf), ["estado", "ano_cadastro"])


@query("place_year_totals", extra_ctes=_TOTALS_CTE, sql="""
SELECT ano_cadastro, CAST(count(*) AS BIGINT) AS n, CAST(count(total_cars_municipio) AS BIGINT) AS n_matched,
       CAST(sum(total_cars_municipio) AS BIGINT) AS sum_total
FROM enriched GROUP BY 1
""")
def place_year_totals(spark, sf):
    """A2 totals per (place, year) left-joined on the composite key."""
    e = enriched(spark, sf)
    return e.groupBy("ano_cadastro").agg(F.count(F.lit(1)).alias("n"),
                                         F.count("total_cars_municipio").alias("n_matched"),
                                         F.sum("total_cars_municipio").cast("long").alias("sum_total"))


@query("join_coverage", extra_ctes=_TOTALS_CTE, sql="""
SELECT CAST(count(total_cars_municipio) AS BIGINT) AS matched,
       CAST(count(*) - count(total_cars_municipio) AS BIGINT) AS unmatched,
       round(count(total_cars_municipio) * 100.0 / count(*), 6) AS pct_matched
FROM enriched
""")
def join_coverage(spark, sf):
    """Matched / unmatched rows after the enrichment join."""
    c = A.join_coverage(enriched(spark, sf), "total_cars_municipio")
    return c.select(F.col("matched").cast("long"), F.col("unmatched").cast("long"), r6("pct_matched"))


@query("distinct_then_sum", extra_ctes=_TOTALS_CTE, sql="""
SELECT 'place' AS grain, ano_cadastro, CAST(sum(t) AS BIGINT) AS total_cars FROM (
  SELECT DISTINCT ano_cadastro, idt_municipio, total_cars_municipio AS t FROM enriched
  WHERE ano_cadastro IS NOT NULL AND total_cars_municipio IS NOT NULL AND municipio_nome IN ('007', '123', '456'))
GROUP BY 2
UNION ALL
SELECT 'state' AS grain, ano_cadastro, CAST(sum(t) AS BIGINT) AS total_cars FROM (
  SELECT DISTINCT ano_cadastro, estado, total_cars_cadastrados AS t FROM enriched
  WHERE ano_cadastro IS NOT NULL AND total_cars_cadastrados IS NOT NULL)
GROUP BY 2
""")
def distinct_then_sum(spark, sf):
    """A4: dedupe (year, grain, total) then sum per year; place grain when places are
    selected, state grain otherwise; size / status filters do not apply."""
    e = enriched(spark, sf)
    p = A.registered_totals_by_year(e, FL.FilterSpec.of(places=["007", "123", "456"], sizes=["Pequeno"]))
    s = A.registered_totals_by_year(e, FL.FilterSpec.of(statuses=["F"]))
    return (p.select(F.lit("place").alias("grain"), "ano_cadastro", F.col("total_cars").cast("long"))
            .unionByName(s.select(F.lit("state").alias("grain"), "ano_cadastro",
                                  F.col("total_cars").cast("long"))))


@query("count_first", extra_ctes=_TOTALS_CTE, sql="""
SELECT ano_cadastro, CAST(count(cod_imovel) AS BIGINT) AS n, CAST(min(total_cars_municipio) AS BIGINT) AS total_cars_municipio
FROM enriched WHERE municipio_nome = '007' GROUP BY 1
""")
def count_first(spark, sf):
    """Per year for one place, count of properties and its attached total."""
    e = enriched(spark, sf).filter(F.col("municipio_nome") == "007")
    r = A.count_and_first(e, ["ano_cadastro"], "cod_imovel", "total_cars_municipio")
    return r.select("ano_cadastro", F.col("n").cast("long"), F.col("total_cars_municipio").cast("long"))


# --- J4, J5, A30: yearly part vs total -----------------------------------------------------

_YEARLY_CTE = """
tot AS (SELECT CAST(year(o_orderdate) AS INT) AS ano_cadastro, count(*) AS total_total FROM orders GROUP BY 1),
part AS (SELECT ano_cadastro, count(DISTINCT cod_imovel) AS total_simi FROM matches
         WHERE ano_cadastro IS NOT NULL GROUP BY 1)"""


def _yearly_parts(spark, sf):
    tot = A.group_size(T(spark, sf, "orders"), [X.year_of("o_orderdate").alias("ano_cadastro")], "total_total")
    part = A.distinct_count(M(spark, sf), "cod_imovel", ["ano_cadastro"], "total_simi")
    return tot, part


@query("yearly_part_total", extra_ctes=_YEARLY_CTE, sql="""
SELECT t.ano_cadastro, CAST(t.total_total AS BIGINT) AS total_total, CAST(coalesce(p.total_simi, 0) AS BIGINT) AS total_simi
FROM tot t LEFT JOIN part p ON t.ano_cadastro = p.ano_cadastro
""")
def yearly_part_total(spark, sf):
    """Totals per year left-joined to distinct matched properties, zero filled."""
    tot, part = _yearly_parts(spark, sf)
    j = J.left_join_fill(tot, part, "ano_cadastro", fill={"total_simi": 0})
    return j.select("ano_cadastro", F.col("total_total").cast("long"), F.col("total_simi").cast("long"))


@query("yearly_full_join", extra_ctes=_YEARLY_CTE, sql="""
SELECT coalesce(t.ano_cadastro, p.ano_cadastro) AS ano_cadastro,
       CAST(coalesce(t.total_total, 0) AS BIGINT) AS total_total, CAST(coalesce(p.total_simi, 0) AS BIGINT) AS total_simi,
       round(CASE WHEN coalesce(t.total_total, 0) > 0 THEN coalesce(p.total_simi, 0) * 100.0 / t.total_total ELSE 0 END, 6)
         AS pct_similaridade
FROM tot t FULL OUTER JOIN part p ON t.ano_cadastro = p.ano_cadastro
""")
def yearly_full_join(spark, sf):
    """J5 + A30: full join of two yearly counts, zero filled, safe percentage."""
    tot, part = _yearly_parts(spark, sf)
    j = A.part_of_total(part, tot, "ano_cadastro", "total_simi", "total_total", "pct_similaridade")
    return j.select("ano_cadastro", F.col("total_total").cast("long"), F.col("total_simi").cast("long"),
                    r6("pct_similaridade"))


# --- J6, A5-A7 -------------------------------------------------------------------------------

@query("place_attributes", extra_ctes="""
s AS (SELECT idt_municipio, CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1),
d AS (SELECT DISTINCT idt_municipio, estado FROM matches)""", sql="""
SELECT s.idt_municipio, s.n, d.estado FROM s LEFT JOIN d ON s.idt_municipio = d.idt_municipio
""")
def place_attributes(spark, sf):
    """Per-place stats left-joined to the distinct (place, state) projection."""
    m = M(spark, sf)
    stats = A.group_size(m, ["idt_municipio"], "n")
    return J.distinct_attributes(m, stats, "idt_municipio", ["estado"]) \
        .select("idt_municipio", F.col("n").cast("long"), "estado")


@query("group_median", """
SELECT estado, round(median(indice), 6) AS median FROM matches WHERE estado IS NOT NULL GROUP BY 1
""")
def group_median(spark, sf):
    """A5: exact median of the index per state."""
    return A.group_median(M(spark, sf), ["estado"], "indice").select("estado", r6("median"))


@query("group_flag_rate", """
SELECT estado, round(avg(cpf_ok) * 100, 6) AS pct FROM matches WHERE estado IS NOT NULL GROUP BY 1
""")
def group_flag_rate(spark, sf):
    """Mean owner flag x 100 per state."""
    return A.group_flag_rate(M(spark, sf), ["estado"], "cpf_ok").select("estado", r6("pct"))


_SCORECARD_SQL = """
SELECT estado, round(avg(CASE WHEN indice >= 0.85 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_espacial_bom,
       round(avg(cpf_ok) * 100, 6) AS pct_cpf_igual, min(regiao) AS regiao, CAST(count(*) AS BIGINT) AS total_cars
FROM matches WHERE estado IS NOT NULL GROUP BY 1"""


@query("area_scorecard", _SCORECARD_SQL)
def area_scorecard(spark, sf):
    """% high index, % owner equal, region, row count per state."""
    s = A.area_scorecard(M(spark, sf), ["estado"])
    return s.select("estado", r6("pct_espacial_bom"), r6("pct_cpf_igual"), "regiao",
                    F.col("total_cars").cast("long"))


# --- A9, A10 ---------------------------------------------------------------------------------

@query("group_size", """
SELECT 'size' AS grouping, class_tam_imovel AS k1, NULL AS k2, CAST(count(*) AS BIGINT) AS n
FROM matches WHERE class_tam_imovel IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'owner_geo', label_cpf, CASE WHEN indice >= 0.85 THEN '>= 85%' ELSE '< 85%' END, CAST(count(*) AS BIGINT)
FROM matches GROUP BY 2, 3
""")
def group_size(spark, sf):
    """Group sizes by one key and by two keys."""
    m = M(spark, sf)
    a = A.group_size(m, ["class_tam_imovel"]).select(
        F.lit("size").alias("grouping"), F.col("class_tam_imovel").alias("k1"),
        F.lit(None).cast("string").alias("k2"), F.col("n").cast("long"))
    b = A.group_size(m.withColumn("label_geo", X.threshold_label("indice")), ["label_cpf", "label_geo"]).select(
        F.lit("owner_geo").alias("grouping"), F.col("label_cpf").alias("k1"), F.col("label_geo").alias("k2"),
        F.col("n").cast("long"))
    return a.unionByName(b)


@query("count_by_year", """
SELECT 'year' AS grouping, CAST(CAST(year(o_orderdate) AS INT) AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 2
UNION ALL
SELECT 'state', n_name, CAST(count(*) AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2
""")
def count_by_year(spark, sf):
    """A10: counts grouped by an expression (year of a timestamp) and by a joined key."""
    a = A.group_size(T(spark, sf, "orders"), [X.year_of("o_orderdate").cast("string").alias("k")])
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    b = A.group_size(c.join(n, c.c_nationkey == n.n_nationkey), [F.col("n_name").alias("k")])
    return (a.select(F.lit("year").alias("grouping"), "k", F.col("n").cast("long"))
            .unionByName(b.select(F.lit("state").alias("grouping"), "k", F.col("n").cast("long"))))


# --- A3, A22 ---------------------------------------------------------------------------------

@query("global_extents", """
SELECT CAST(count(DISTINCT cod_imovel) AS BIGINT) AS n_imoveis, CAST(count(DISTINCT estado) AS BIGINT) AS n_ufs,
       min(ano_cadastro) AS ano_min, max(ano_cadastro) AS ano_max, round(max(area_a) - min(area_a), 6) AS area_span
FROM matches
""")
def global_extents(spark, sf):
    """A3 global distinct counts, A22 min / max / span."""
    out = A.overview(M(spark, sf), distinct={"n_imoveis": "cod_imovel", "n_ufs": "estado"},
                     extent={"ano": "ano_cadastro", "area": "area_a"})
    return out.select("n_imoveis", "n_ufs", "ano_min", "ano_max", r6("area_span"))


# --- A11, W3 ---------------------------------------------------------------------------------

@query("series_agg", """
SELECT 'mean' AS agg, ano_cadastro, NULL AS class_tam_imovel, round(avg(indice), 6) AS value FROM matches
WHERE ano_cadastro IS NOT NULL GROUP BY 2
UNION ALL SELECT 'median', ano_cadastro, NULL, round(median(indice), 6) FROM matches WHERE ano_cadastro IS NOT NULL GROUP BY 2
UNION ALL SELECT 'sum', ano_cadastro, NULL, round(sum(area_a), 2) FROM matches WHERE ano_cadastro IS NOT NULL GROUP BY 2
UNION ALL SELECT 'median', ano_cadastro, class_tam_imovel, round(median(indice), 6) FROM matches
WHERE ano_cadastro IS NOT NULL AND class_tam_imovel IS NOT NULL GROUP BY 2, 3
""")
def series_agg(spark, sf):
    """Yearly series with a selectable aggregate, single and multi-series."""
    m = M(spark, sf)

    def fmt(df, agg, hue, digits=6):
        return df.select(F.lit(agg).alias("agg"), "ano_cadastro",
                         (F.col(hue) if hue else F.lit(None).cast("string")).alias("class_tam_imovel"),
                         F.round("value", digits).alias("value"))
    return (fmt(A.series_agg(m, "ano_cadastro", "indice", "mean"), "mean", None)
            .unionByName(fmt(A.series_agg(m, "ano_cadastro", "indice", "median"), "median", None))
            .unionByName(fmt(A.series_agg(m, "ano_cadastro", "area_a", "sum"), "sum", None, 2))
            .unionByName(fmt(A.series_agg(m, "ano_cadastro", "indice", "median", hue="class_tam_imovel"),
                             "median", "class_tam_imovel")))


@query("series_endpoints", extra_ctes="""
s AS (SELECT class_tam_imovel, ano_cadastro, median(indice) AS v FROM matches
      WHERE ano_cadastro IS NOT NULL AND class_tam_imovel IS NOT NULL GROUP BY 1, 2)""", sql="""
SELECT class_tam_imovel, min(ano_cadastro) AS x_first, round(arg_min(v, ano_cadastro), 6) AS y_first,
       max(ano_cadastro) AS x_last, round(arg_max(v, ano_cadastro), 6) AS y_last
FROM s GROUP BY 1
""")
def series_endpoints(spark, sf):
    """First and last point of each yearly median series."""
    s = A.series_agg(M(spark, sf), "ano_cadastro", "indice", "median", hue="class_tam_imovel")
    e = WN.series_endpoints(s, "ano_cadastro", "value", ["class_tam_imovel"])
    return e.select("class_tam_imovel", "x_first", r6("y_first"), "x_last", r6("y_last"))


# --- A12-A16: frequency / contingency ----------------------------------------------------------

@query("freq_share", """
SELECT faixa_jaccard, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM matches WHERE faixa_jaccard IS NOT NULL GROUP BY 1
""")
def freq_share(spark, sf):
    """Value counts and share of the band column."""
    f = A.freq_share(M(spark, sf), "faixa_jaccard")
    return f.select("faixa_jaccard", F.col("n").cast("long"), r6("pct"))


_CT = "FROM matches WHERE label_cpf IS NOT NULL AND faixa_jaccard IS NOT NULL GROUP BY 1, 2"


@query("crosstab_counts", f"SELECT label_cpf, faixa_jaccard, CAST(count(*) AS BIGINT) AS n {_CT}")
def crosstab_counts(spark, sf):
    """Owner label x band counts (long form)."""
    c = A.crosstab_counts(M(spark, sf), "label_cpf", "faixa_jaccard")
    return c.select("label_cpf", "faixa_jaccard", F.col("n").cast("long"))


@query("crosstab_col_pct", f"""
SELECT label_cpf, faixa_jaccard, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY faixa_jaccard), 6) AS pct {_CT}
""")
def crosstab_col_pct(spark, sf):
    """Column-normalised percentages."""
    c = A.normalized_share(A.crosstab_counts(M(spark, sf), "label_cpf", "faixa_jaccard"), ["faixa_jaccard"])
    return c.select("label_cpf", "faixa_jaccard", r6("pct"))


@query("crosstab_row_pct", f"""
SELECT label_cpf, faixa_jaccard, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label_cpf), 6) AS pct {_CT}
""")
def crosstab_row_pct(spark, sf):
    """Row-normalised percentages (100 % stacked bars)."""
    c = A.normalized_share(A.crosstab_counts(M(spark, sf), "label_cpf", "faixa_jaccard"), ["label_cpf"])
    return c.select("label_cpf", "faixa_jaccard", r6("pct"))


@query("crosstab_margins", """
SELECT coalesce(label_cpf, '__all__') AS label_cpf, coalesce(faixa_jaccard, '__all__') AS faixa_jaccard,
       CASE grouping(label_cpf, faixa_jaccard) WHEN 0 THEN 'cell' WHEN 1 THEN 'row_total'
            WHEN 2 THEN 'col_total' ELSE 'grand_total' END AS level,
       CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 100.0 / sum(CASE WHEN grouping(label_cpf, faixa_jaccard) = 3 THEN count(*) END) OVER (), 6)
         AS pct_total
FROM matches WHERE label_cpf IS NOT NULL AND faixa_jaccard IS NOT NULL
GROUP BY CUBE (label_cpf, faixa_jaccard)
""")
def crosstab_margins(spark, sf):
    """Cells, row / column totals and grand total via one CUBE."""
    c = A.crosstab_margins(M(spark, sf), "label_cpf", "faixa_jaccard")
    return c.select("label_cpf", "faixa_jaccard", "level", F.col("n").cast("long"), r6("pct_total"))


@query("band_distribution", extra_ctes="""
d1 AS (SELECT * FROM (VALUES ('Diferente', 1), ('Igual', 2)) t(label_cpf, ord_cpf)),
d2 AS (SELECT * FROM (VALUES ('0-25%', 1), ('25-50%', 2), ('50-85%', 3), ('85-100%', 4)) t(faixa_jaccard, ord_faixa)),
c AS (SELECT label_cpf, faixa_jaccard, count(*) AS n FROM matches GROUP BY 1, 2)""", sql="""
SELECT d1.label_cpf, d2.faixa_jaccard, d1.ord_cpf, d2.ord_faixa, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM d1 CROSS JOIN d2 LEFT JOIN c ON c.label_cpf = d1.label_cpf AND c.faixa_jaccard = d2.faixa_jaccard
""")
def band_distribution(spark, sf):
    """J9 + O4: every (owner label, band) cell present in display order, zero filled."""
    c = A.crosstab_counts(M(spark, sf), "label_cpf", "faixa_jaccard")
    full = J.complete_domain(c, {"label_cpf": L.OWNER_LABELS, "faixa_jaccard": L.JACCARD_LABELS}, {"n": 0},
                             order_cols={"label_cpf": "ord_cpf", "faixa_jaccard": "ord_faixa"})
    return full.select("label_cpf", "faixa_jaccard", "ord_cpf", "ord_faixa", F.col("n").cast("long")) \
        .orderBy("ord_cpf", "ord_faixa")


# --- J10, O2: top-20 with 'Outros' ----------------------------------------------------------------

@query("top20_others", extra_ctes="""
c AS (SELECT municipio_nome, count(*) AS n FROM matches WHERE municipio_nome IS NOT NULL GROUP BY 1),
top AS (SELECT municipio_nome FROM c ORDER BY n DESC, municipio_nome LIMIT 20),
k AS (SELECT count(*) AS k FROM c)""", sql="""
SELECT CASE WHEN (SELECT k FROM k) <= 20 THEN m.municipio_nome
            WHEN m.municipio_nome IN (SELECT municipio_nome FROM top) THEN m.municipio_nome
            ELSE 'Outros' END AS place,
       CAST(count(*) AS BIGINT) AS n
FROM matches m GROUP BY 1
""")
def top20_others(spark, sf):
    """O2 + J10: the 20 most frequent places kept, the rest (and nulls) relabelled 'Outros'."""
    r = TK.top_k_or_other(M(spark, sf), "municipio_nome", L.TOP_K_PLACES, L.OTHERS_LABEL, "place")
    return r.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


# --- J11, A24: min-max rescale ----------------------------------------------------------------------

@query("minmax_rescale", extra_ctes="""
c AS (SELECT estado, count(*) AS n FROM matches WHERE estado IS NOT NULL GROUP BY 1)""", sql="""
SELECT estado, CAST(n AS BIGINT) AS n,
       round(CASE WHEN max(n) OVER () = min(n) OVER () THEN 100.0
                  ELSE (n - min(n) OVER ()) * 1.0 / (max(n) OVER () - min(n) OVER ()) * 700 + 100 END, 6) AS size
FROM c
""")
def minmax_rescale(spark, sf):
    """J11 + A24: counts per state rescaled to bubble sizes [100, 800]."""
    c = A.group_size(M(spark, sf), ["estado"])
    r = A.minmax_rescale(c, "n", L.BUBBLE_MIN, L.BUBBLE_MAX, "size")
    return r.select("estado", F.col("n").cast("long"), r6("size"))


# --- A15: 100 % stacked shares for several (y, hue) pairs in one pass -----------------------------

_STACK_PAIRS = [("regiao", "faixa_jaccard"), ("estado", "faixa_jaccard"), ("estado", "label_cpf"),
                ("faixa_jaccard", "label_cpf"), ("class_tam_imovel", "faixa_jaccard"),
                ("status_imovel", "faixa_jaccard")]


@query("stacked_shares", extra_ctes="c AS (" + " UNION ALL ".join(
    f"SELECT '{y}x{h}' AS pair, CAST({y} AS VARCHAR) AS y, CAST({h} AS VARCHAR) AS hue, count(*) AS n "
    f"FROM matches WHERE {y} IS NOT NULL AND {h} IS NOT NULL GROUP BY 2, 3" for y, h in _STACK_PAIRS) + ")", sql="""
SELECT pair, y, hue, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (PARTITION BY pair, y), 6) AS pct FROM c
""")
def stacked_shares(spark, sf):
    """Row-normalised shares (100 % stacked bars) for six (y, hue) pairs,
    all counted in one scan of the fact table."""
    m = M(spark, sf)
    lg = m.select(F.explode(F.array(*[
        F.struct(F.lit(f"{y}x{h}").alias("pair"), F.col(y).cast("string").alias("y"),
                 F.col(h).cast("string").alias("hue")) for y, h in _STACK_PAIRS])).alias("s")).select("s.*")
    c = lg.filter(F.col("y").isNotNull() & F.col("hue").isNotNull()) \
        .groupBy("pair", "y", "hue").agg(F.count(F.lit(1)).alias("n"))
    s = A.normalized_share(c, ["pair", "y"])
    return s.select("pair", "y", "hue", F.col("n").cast("long"), r6("pct"))


# --- distinct counts from stored sketches (A2, A3 opt-in) -------------------------------

@query("distinct_sketches", """
SELECT regiao, estado, CAST(count(DISTINCT cod_imovel) AS BIGINT) AS n_exact, TRUE AS within
FROM matches WHERE ano_cadastro BETWEEN 1994 AND 1997 AND regiao IN ('AMERICA', 'ASIA') GROUP BY ALL
""")
def distinct_sketches(spark, sf):
    """A2, opt-in: properties by state under a filter, from stored sketches of places and years, beside
    the exact count; ``within``: they differ by no more than the stated error."""
    keep = F.col("ano_cadastro").between(1994, 1997) & F.col("regiao").isin("AMERICA", "ASIA")
    est = SK.merged_distinct(property_sketches(spark, sf), ["regiao", "estado"], keep, "n_est")
    exact = M(spark, sf).where(keep).groupBy("regiao", "estado").agg(F.countDistinct("cod_imovel").alias("n_exact"))
    near = F.abs(F.col("n_est") - F.col("n_exact")) <= F.ceil(F.lit(SK.error_bound()) * F.col("n_exact"))
    return exact.join(est, ["regiao", "estado"], "left").select(
        "regiao", "estado", "n_exact", F.coalesce(near, F.lit(False)).alias("within"))
