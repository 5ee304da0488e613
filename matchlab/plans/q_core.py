"""Core queries: load slice, KPI row, derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregate as A
from .common import M, SPEC, SPEC_SQL
from .registry import query, r6

_KPI_SQL_COLS = """CAST(count(*) AS BIGINT) AS total_records,
  round(coalesce(avg(indice) * 100, 0), 6) AS avg_jaccard,
  round(coalesce(median(indice) * 100, 0), 6) AS median_jaccard,
  CAST(count(DISTINCT estado) AS BIGINT) AS num_ufs,
  round(coalesce(sum(area_a), 0), 2) AS total_area,
  round(coalesce(avg(cpf_ok) * 100, 0), 6) AS avg_cpf_ok"""


def _kpi_out(df, variant):
    return df.select(F.lit(variant).alias("variant"), "total_records", r6("avg_jaccard"),
                     r6("median_jaccard"), "num_ufs", F.round("total_area", 2).alias("total_area"),
                     r6("avg_cpf_ok"))


@query("kpi_row", f"""
SELECT 'all' AS variant, {_KPI_SQL_COLS} FROM matches
UNION ALL
SELECT 'filtered' AS variant, {_KPI_SQL_COLS} FROM matches WHERE {SPEC_SQL}
""")
def kpi_row(spark, sf):
    """A1 (flagship): six KPIs over all rows and over the filtered rows."""
    m = M(spark, sf)
    return _kpi_out(A.kpi_row(m), "all").unionByName(_kpi_out(A.kpi_row(SPEC.apply(m)), "filtered"))


@query("total_records", "SELECT CAST(count(*) AS BIGINT) AS total_records FROM matches")
def total_records(spark, sf):
    """Row count of the fact table."""
    return M(spark, sf).agg(F.count(F.lit(1)).cast("long").alias("total_records"))


# --- S7: derived table ---------------------------------------------------------

_DERIVED = ["cpf_ok", "label_cpf", "ano_cadastro", "faixa_jaccard", "class_tam_imovel"]


@query("derived_table", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n "
    f"FROM matches GROUP BY {c}" for c in _DERIVED))
def derived_table(spark, sf):
    """The materialised derived columns, counted by value (nulls kept)."""
    m = M(spark, sf)
    lg = m.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in _DERIVED])).alias("s")).select("s.*")
    return lg.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


# --- P4, P5, P6 ----------------------------------------------------------------------

@query("normalize_flags", """
SELECT CASE WHEN lower(CAST(igualdade_txt AS VARCHAR)) IN ('true','1','t') THEN 1 ELSE 0 END AS cpf_ok,
       CASE WHEN lower(CAST(igualdade_txt AS VARCHAR)) IN ('true','1','t') THEN 'Igual' ELSE 'Diferente' END AS label_cpf,
       CASE WHEN dono_igual THEN 'Igual' WHEN NOT dono_igual THEN 'Diferente' END AS label_dono,
       CAST(count(*) AS BIGINT) AS n
FROM raw_matches GROUP BY ALL
""")
def normalize_flags(spark, sf):
    """Text flag -> 0/1 and label (null -> 0); strict boolean label (null stays null)."""
    r = M(spark, sf)
    return (r.select(X.truthy_flag("igualdade_txt").alias("cpf_ok"),
                     X.truthy_label("igualdade_txt").alias("label_cpf"),
                     X.bool_label("dono_igual").alias("label_dono"))
            .groupBy("cpf_ok", "label_cpf", "label_dono").agg(F.count(F.lit(1)).alias("n")))


@query("year_from_text", """
SELECT 'text' AS source, CAST(year(try_cast(data_cadastro_imovel AS date)) AS INT) AS ano, CAST(count(*) AS BIGINT) AS n
FROM raw_matches GROUP BY 2
UNION ALL
SELECT 'timestamp' AS source, CAST(year(o_orderdate) AS INT) AS ano, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 2
""")
def year_from_text(spark, sf):
    """P5: year of a possibly bad date text (bad -> NULL); P6: year of a timestamp."""
    from .common import T
    a = (M(spark, sf).select(F.lit("text").alias("source"), X.year_from_text("data_cadastro_imovel").alias("ano"))
         .groupBy("source", "ano").agg(F.count(F.lit(1)).alias("n")))
    b = (T(spark, sf, "orders").select(F.lit("timestamp").alias("source"), X.year_of("o_orderdate").alias("ano"))
         .groupBy("source", "ano").agg(F.count(F.lit(1)).alias("n")))
    return a.unionByName(b)


# --- P7-P10: banding ------------------------------------------------------------------

def _band_counts(spark, sf, col_expr, fn):
    return (M(spark, sf).select(fn(col_expr).alias("faixa"))
            .groupBy("faixa").agg(F.count(F.lit(1)).alias("n")))


@query("band_left", """
SELECT CASE WHEN indice >= 0 AND indice < 0.25 THEN '0-25%' WHEN indice >= 0.25 AND indice < 0.5 THEN '25-50%'
            WHEN indice >= 0.5 AND indice < 0.85 THEN '50-85%' WHEN indice >= 0.85 AND indice <= 1.0 THEN '85-100%' END AS faixa,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1
""")
def band_left(spark, sf):
    """Left-closed bands, last band closed on the right."""
    return _band_counts(spark, sf, F.col("indice"), X.jaccard_band)


@query("band_percent", """
SELECT CASE WHEN x >= 0 AND x < 25 THEN '0-25%' WHEN x >= 25 AND x < 50 THEN '25-50%'
            WHEN x >= 50 AND x < 85 THEN '50-85%' WHEN x >= 85 AND x < 100.1 THEN '85-100%' END AS faixa,
       CAST(count(*) AS BIGINT) AS n FROM (SELECT indice * 100 AS x FROM matches) GROUP BY 1
""")
def band_percent(spark, sf):
    """Right-open bins on the percent scale."""
    return _band_counts(spark, sf, F.col("indice") * 100, X.jaccard_pct_band)


@query("band_right", """
SELECT CASE WHEN indice >= 0 AND indice <= 0.2 THEN '0-20%' WHEN indice > 0.2 AND indice <= 0.4 THEN '20-40%'
            WHEN indice > 0.4 AND indice <= 0.6 THEN '40-60%' WHEN indice > 0.6 AND indice <= 0.8 THEN '60-80%'
            WHEN indice > 0.8 AND indice <= 1.0 THEN '80-100%' END AS faixa,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1
""")
def band_right(spark, sf):
    """Right-closed bins, lowest edge included."""
    return _band_counts(spark, sf, F.col("indice"), X.risk_band)


@query("band_open", """
SELECT CASE WHEN discrepancia <= -10 THEN 'Car < Sigef' || chr(10) || '(> -10%)'
            WHEN discrepancia > -10 AND discrepancia <= -1 THEN 'Car < Sigef' || chr(10) || '(-1% a -10%)'
            WHEN discrepancia > -1 AND discrepancia <= 1 THEN 'Exato' || chr(10) || '(± 1%)'
            WHEN discrepancia > 1 AND discrepancia <= 10 THEN 'Car > Sigef' || chr(10) || '(+1% a +10%)'
            WHEN discrepancia > 10 THEN 'Car > Sigef' || chr(10) || '(> +10%)' END AS faixa,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1
""")
def band_open(spark, sf):
    """P10: open-ended right-closed bins of the area discrepancy."""
    return _band_counts(spark, sf, F.col("discrepancia"), X.discrepancy_band)


# --- P11, P13, P14: classes ------------------------------------------------------------

@query("size_class", """
SELECT 'modules' AS variant, CASE WHEN round(CAST(num_modulo AS DECIMAL(20,6)), 4) <= 4 THEN 'Pequeno'
       WHEN round(CAST(num_modulo AS DECIMAL(20,6)), 4) <= 15 THEN 'Médio' ELSE 'Grande' END AS classe,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 2
UNION ALL
SELECT 'edge' AS variant, CASE WHEN round(CAST(num_modulo + linha * 0.00001 AS DECIMAL(20,6)), 4) <= 4 THEN 'Pequeno'
       WHEN round(CAST(num_modulo + linha * 0.00001 AS DECIMAL(20,6)), 4) <= 15 THEN 'Médio' ELSE 'Grande' END AS classe,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 2
UNION ALL
SELECT 'scaled' AS variant, CASE WHEN round(CAST(indice * 20 AS DECIMAL(20,6)), 4) <= 4 THEN 'Pequeno'
       WHEN round(CAST(indice * 20 AS DECIMAL(20,6)), 4) <= 15 THEN 'Médio' ELSE 'Grande' END AS classe,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 2
""")
def size_class(spark, sf):
    """Size class after HALF_UP rounding to 4 decimals; NULL falls to 'Grande'."""
    m = M(spark, sf)
    a = m.select(F.lit("modules").alias("variant"), X.size_class("num_modulo").alias("classe"))
    b = m.select(F.lit("scaled").alias("variant"), X.size_class(F.col("indice") * 20).alias("classe"))
    # 4.00001 .. 4.00007: five and more of the last place round up past the limit
    edge = F.col("num_modulo") + F.col("linha") * F.lit(0.00001).cast("decimal(10,5)")
    c = m.select(F.lit("edge").alias("variant"), X.size_class(edge).alias("classe"))
    return a.unionByName(b).unionByName(c).groupBy("variant", "classe").agg(F.count(F.lit(1)).alias("n"))


@query("tolerance_class", """
SELECT CASE WHEN discrepancia BETWEEN -10 AND 10 THEN 'Preciso' WHEN discrepancia > 10 THEN 'Superestimado (CAR > SIGEF)'
            WHEN discrepancia < -10 THEN 'Subestimado (CAR < SIGEF)' END AS status_area,
       CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1
""")
def tolerance_class(spark, sf):
    """Tolerance classes at +/-10 %, NULL stays NULL."""
    return (M(spark, sf).select(X.tolerance_class("discrepancia").alias("status_area"))
            .groupBy("status_area").agg(F.count(F.lit(1)).alias("n")))


@query("threshold_label", """
SELECT CASE WHEN indice >= 0.85 THEN '>= 85%' ELSE '< 85%' END AS label_geo, CAST(count(*) AS BIGINT) AS n
FROM matches GROUP BY 1
""")
def threshold_label(spark, sf):
    """Binary threshold label (NULL counts as below)."""
    return (M(spark, sf).select(X.threshold_label("indice").alias("label_geo"))
            .groupBy("label_geo").agg(F.count(F.lit(1)).alias("n")))


# --- P12, P22, P30: guarded arithmetic --------------------------------------------------

@query("relative_diff", """
SELECT round(min(d), 6) AS min_d, round(avg(d), 6) AS avg_d, round(max(d), 6) AS max_d,
       CAST(count(*) - count(d) AS BIGINT) AS n_null
FROM (SELECT ((area_a - area_b) / nullif(area_b, 0)) * 100 AS d FROM raw_matches)
""")
def relative_diff(spark, sf):
    """Relative difference in percent with a zero-divisor guard."""
    d = M(spark, sf).select(X.relative_diff_pct("area_a", "area_b").alias("d"))
    return d.agg(r6(F.min("d"), "min_d"), r6(F.avg("d"), "avg_d"), r6(F.max("d"), "max_d"),
                 (F.count(F.lit(1)) - F.count("d")).cast("long").alias("n_null"))


@query("safe_pct", """
SELECT round(min(p), 6) AS min_p, round(avg(p), 6) AS avg_p, round(max(p), 6) AS max_p,
       CAST(count_if(p = 0) AS BIGINT) AS n_zero
FROM (SELECT CASE WHEN area_b > 0 THEN area_a / area_b * 100 ELSE 0 END AS p FROM raw_matches)
""")
def safe_pct(spark, sf):
    """Part / total x 100 when total > 0 else 0."""
    p = M(spark, sf).select(X.safe_pct("area_a", "area_b").alias("p"))
    return p.agg(r6(F.min("p"), "min_p"), r6(F.avg("p"), "avg_p"), r6(F.max("p"), "max_p"),
                 F.count_if(F.col("p") == 0).cast("long").alias("n_zero"))


@query("jaccard_from_areas", """
SELECT CAST(count(j) AS BIGINT) AS n_checked,
       CAST(count_if(abs(j - indice) > 1e-9) AS BIGINT) AS n_mismatch,
       round(avg(j), 6) AS avg_j
FROM (SELECT indice, least(area_a, area_b) / nullif(area_a + area_b - least(area_a, area_b), 0) AS j FROM raw_matches)
""")
def jaccard_from_areas(spark, sf):
    """Index from areas (inter / union) and consistency with the stored index."""
    m = M(spark, sf)
    j = m.select("indice", X.jaccard_from_areas("area_a", "area_b", F.least("area_a", "area_b")).alias("j"))
    return j.agg(F.count("j").cast("long").alias("n_checked"),
                 F.count_if(F.abs(F.col("j") - F.col("indice")) > 1e-9).cast("long").alias("n_mismatch"),
                 r6(F.avg("j"), "avg_j"))


# --- P15, P18, P19, P25 --------------------------------------------------------------------

@query("scale_cast", """
SELECT substr(CAST(data_cadastro_imovel AS VARCHAR), 1, 4) AS prefixo, CAST(count(*) AS BIGINT) AS n,
       round(avg(round(indice * 100, 2)), 6) AS avg_pct, CAST(max(CAST(ano_cadastro AS VARCHAR)) AS VARCHAR) AS max_ano_txt
FROM matches GROUP BY 1
""")
def scale_cast(spark, sf):
    """P15 percent scale, P25 rounding, P18 text prefix, P19 casts."""
    m = M(spark, sf)
    return (m.select(X.text_prefix("data_cadastro_imovel", 4).alias("prefixo"),
                     F.round(F.col("indice") * 100, 2).alias("pct"),
                     F.col("ano_cadastro").cast("string").alias("ano_txt"))
            .groupBy("prefixo").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pct"), "avg_pct"),
                                    F.max("ano_txt").alias("max_ano_txt")))


# --- P16: dictionary lookups -----------------------------------------------------------------

# Stand-in status dictionary with one code ('P') deliberately left out.
STATUS_LABELS = {"F": "Finalizado", "O": "Aberto"}
_MAP_CASE = "CASE status_imovel WHEN 'F' THEN 'Finalizado' WHEN 'O' THEN 'Aberto' END"


@query("map_replace", f"SELECT coalesce({_MAP_CASE}, status_imovel) AS status, CAST(count(*) AS BIGINT) AS n "
                      "FROM matches GROUP BY 1")
def map_replace(spark, sf):
    """P16 replace: unmatched codes keep their value."""
    return (M(spark, sf).select(X.map_replace("status_imovel", STATUS_LABELS).alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("map_strict", f"SELECT {_MAP_CASE} AS status, CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1")
def map_strict(spark, sf):
    """P16 map: unmatched codes become NULL."""
    return (M(spark, sf).select(X.map_strict("status_imovel", STATUS_LABELS).alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("map_default", f"SELECT coalesce({_MAP_CASE}, 'Outro') AS status, CAST(count(*) AS BIGINT) AS n "
                      "FROM matches GROUP BY 1")
def map_default(spark, sf):
    """P16 get-with-default: unmatched codes become the default label."""
    return (M(spark, sf).select(X.map_default("status_imovel", STATUS_LABELS, "Outro").alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


# --- P17, P29: text normalisation ------------------------------------------------------------

_TITLE = ("CASE WHEN {c} IS NULL THEN NULL WHEN length({c}) = 0 THEN '' ELSE list_reduce("
          "list_prepend(upper(substr(lower({c}), 1, 1)), str_split(substr(lower({c}), 2), '')), "
          "lambda acc, ch: acc || CASE WHEN regexp_matches(right(acc, 1), '\\p{{L}}') THEN ch ELSE upper(ch) END) END")


def _code_sql(col, src, table):
    return (f"SELECT '{src}' AS source, upper(substr({col}, 1, 1)) || lower(substr({col}, 2)) AS cap, "
            f"replace(replace(lower(trim({col})), '-', '_'), ' ', '_') AS slug, "
            f"split_part(trim({col}), ' ', 1) AS token, upper(substr({col}, 1, 2)) AS code2, "
            f"{_TITLE.format(c=col)} AS title, "
            f"CASE WHEN contains({col}, ' ') THEN split_part({col}, ' ', 1) ELSE substr({col}, 1, 2) END AS sigla, "
            f"CAST(count(*) AS BIGINT) AS n FROM {table} GROUP BY ALL")


@query("code_text", _code_sql("p_name", "part", "part") + " UNION ALL " +
       _code_sql("o_orderpriority", "orders", "orders") + " UNION ALL " +
       _code_sql("r_name", "region", "region"))
def code_text(spark, sf):
    """P17 capitalise; P29 slug, first token, 2-char code, Python-style title
    case and the state-code fallback (token when spaced, else 2 chars)."""
    from .common import T

    def one(df, col, src):
        # the text functions depend on the value only: evaluate them once per
        # distinct value (map-side counted), then add the counts up
        vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
        return (vc.select(F.lit(src).alias("source"), X.capitalize(col).alias("cap"), X.slug(col).alias("slug"),
                          X.first_token(col).alias("token"), X.code2(col).alias("code2"),
                          X.title_case(col).alias("title"), X.state_code(col).alias("sigla"), "_c")
                .groupBy("source", "cap", "slug", "token", "code2", "title", "sigla")
                .agg(F.sum("_c").alias("n")))
    return (one(T(spark, sf, "part"), "p_name", "part")
            .unionByName(one(T(spark, sf, "orders"), "o_orderpriority", "orders"))
            .unionByName(one(T(spark, sf, "region"), "r_name", "region")))


# --- P1-P3, P24: projection ------------------------------------------------------------------

@query("project_rename", """
SELECT regiao_analise, uf, fonte, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT regiao AS regiao_analise, estado AS uf, 'matches' AS fonte FROM matches) GROUP BY ALL
""")
def project_rename(spark, sf):
    """P1 aliases, P2 rename (by name and positional), P3 prune and drop, P24 literal tag."""
    m = M(spark, sf)
    p = (m.select("*", F.col("regiao").alias("regiao_analise"), F.lit("matches").alias("fonte"))
         .withColumnsRenamed({"estado": "uf"})
         .select("regiao_analise", "uf", "fonte", "tipo_imovel")
         .drop("tipo_imovel")
         .toDF("r", "u", "f")                      # positional rename
         .toDF("regiao_analise", "uf", "fonte"))
    return p.groupBy("regiao_analise", "uf", "fonte").agg(F.count(F.lit(1)).alias("n"))
