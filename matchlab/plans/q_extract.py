"""Extraction, sources and sinks: best match (J1, W1, P23), yearly pivot (A8, X2,
J2, P20, P21), partitioned union (S4, X1), CSV round trip (S1, S2, S6), frame
SQL (S5), feature join (S8), preview / sample (O3), compact numbers (P26)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import labels as L
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import topk as TK
from ..operators import windows as WN
from ..session import checkpoint_dir
from ..sources import blocks as B
from ..sources import files as S
from ..sources import fixtures
from .common import M, R, T, by_property
from .registry import query, r6

_BEST_CTE = """
best_last AS (SELECT cod_imovel, indice, dono_igual, id_vizinhanca, id_parte, linha FROM (
  SELECT *, row_number() OVER (PARTITION BY cod_imovel ORDER BY indice DESC NULLS LAST,
         CASE WHEN dono_igual THEN 0 ELSE 1 END, id_vizinhanca, id_parte, linha) AS rn FROM raw_matches) WHERE rn = 1),
best AS (SELECT cod_imovel, indice, dono_igual, id_vizinhanca, id_parte, linha FROM (
  SELECT *, row_number() OVER (PARTITION BY cod_imovel ORDER BY indice DESC NULLS FIRST,
         CASE WHEN dono_igual THEN 0 ELSE 1 END, id_vizinhanca, id_parte, linha) AS rn FROM raw_matches) WHERE rn = 1)"""


def best_matches(spark, sf, raw=None, nulls_first=True):
    """J1 (join chain of the extraction) + W1 best row per property; only the
    ordered-by columns are kept, so ties cannot change the output.  ``raw``
    may be the materialised table instead of the join chain. A missing index comes first,
    as a descending order has it by default, or last as an option."""
    r = R(spark, sf) if raw is None else raw
    index = F.col("indice").desc_nulls_first() if nulls_first else F.col("indice").desc_nulls_last()
    order = [index, WN.owner_first("dono_igual"), F.col("id_vizinhanca"),
             F.col("id_parte"), F.col("linha")]
    b = WN.best_per_key(r, "cod_imovel", order)
    return b.select("cod_imovel", "indice", "dono_igual", "id_vizinhanca", "id_parte", "linha")


@query("best_match", extra_ctes=_BEST_CTE, sql="""
SELECT cod_imovel, round(indice, 6) AS indice, dono_igual, id_vizinhanca, id_parte, linha FROM best
""")
def best_match(spark, sf):
    """J1 + W1 + P23: best match per property."""
    b = best_matches(spark, sf)
    return b.select("cod_imovel", r6("indice"), "dono_igual", "id_vizinhanca", "id_parte", "linha")


@query("best_match_nulls_last", extra_ctes=_BEST_CTE, sql="""
SELECT cod_imovel, round(indice, 6) AS indice, dono_igual, id_vizinhanca, id_parte, linha FROM best_last
""")
def best_match_nulls_last(spark, sf):
    """W1 option: a row with an index beats one without."""
    b = best_matches(spark, sf, nulls_first=False)
    return b.select("cod_imovel", r6("indice"), "dono_igual", "id_vizinhanca", "id_parte", "linha")


@query("best_match_colocated", extra_ctes=_BEST_CTE + """,
per AS (SELECT cod_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(indice), 6) AS avg_indice FROM raw_matches GROUP BY 1)""", sql="""
SELECT b.cod_imovel, round(indice, 6) AS indice, dono_igual, id_vizinhanca, id_parte, linha, n, avg_indice
FROM best b JOIN per p ON p.cod_imovel = b.cod_imovel
""")
def best_match_colocated(spark, sf):
    """S7 bucketed by property: W1 best row, joined to the profile of the property, without an exchange."""
    def operator(rows):
        per = rows.groupBy("cod_imovel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("indice"), "avg_indice"))
        return best_matches(spark, sf, raw=rows).join(per, "cod_imovel")
    b = by_property(spark, sf).per_key(operator)
    return b.select("cod_imovel", r6("indice"), "dono_igual", "id_vizinhanca", "id_parte", "linha", "n", "avg_indice")


@query("best_match_owners", extra_ctes="""
bridge AS (SELECT o_orderkey AS cod_imovel, o_custkey AS dono FROM orders WHERE o_orderkey % 7 <> 3
           UNION SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 2 = 0),
fan AS (SELECT m.cod_imovel, indice, id_vizinhanca, id_parte, linha,
               coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END = s_nationkey, FALSE) AS mesmo_dono
        FROM matches m JOIN bridge b ON b.cod_imovel = m.cod_imovel JOIN customer ON c_custkey = dono JOIN supplier ON s_suppkey = id_vizinhanca)""",
       sql="""
SELECT cod_imovel, round(indice, 6) AS indice, mesmo_dono, id_vizinhanca, id_parte, linha FROM (
  SELECT *, row_number() OVER (PARTITION BY cod_imovel ORDER BY indice DESC NULLS FIRST, mesmo_dono DESC,
                               id_vizinhanca, id_parte, linha) AS rn FROM fan) WHERE rn = 1
""")
def best_match_owners(spark, sf):
    """J1 with its n:m owner bridge + W1: a match of one of the owners wins among equal indices."""
    b = J.best_match_by_owner(M(spark, sf).select("cod_imovel", "indice", "id_vizinhanca", "id_parte", "linha"),
                              *fixtures.owner_tables(spark, sf), "cod_imovel", "id_vizinhanca", "indice", ["id_vizinhanca", "id_parte", "linha"])
    return b.select("cod_imovel", r6("indice"), "mesmo_dono", "id_vizinhanca", "id_parte", "linha")


YEARS = list(range(1995, 2002))
NO_OVERLAP = "Sem sobreposição a desmatamento"
_D = ", ".join(f"coalesce(sum(area) FILTER (WHERE ano = {y}), 0) AS d{y}" for y in YEARS)
_DJ = ", ".join(f"coalesce(p.d{y}, 0) AS d{y}" for y in YEARS)
_DS = ", ".join(f"round(sum(d{y}), 2) AS d{y}" for y in YEARS)
_DT = " + ".join(f"coalesce(p.d{y}, 0)" for y in YEARS)


@query("yearly_pivot", extra_ctes=_BEST_CTE + f""",
des AS (SELECT DISTINCT l_orderkey AS cod_imovel, CAST(year(l_shipdate) AS INT) AS ano, l_quantity AS area,
        l_returnflag AS bioma FROM lineitem),
piv AS (SELECT cod_imovel, upper(substr(bioma, 1, 1)) || lower(substr(bioma, 2)) AS bioma, {_D} FROM des GROUP BY 1, 2),
j AS (SELECT b.cod_imovel, coalesce(p.bioma, '{NO_OVERLAP}') AS bioma_desmat, {_DJ}, {_DT} AS d_total
      FROM best b LEFT JOIN piv p ON b.cod_imovel = p.cod_imovel)""", sql=f"""
SELECT bioma_desmat, CAST(count(*) AS BIGINT) AS n, {_DS}, round(sum(d_total), 2) AS d_total FROM j GROUP BY 1
""")
def yearly_pivot(spark, sf):
    """X2 distinct yearly areas -> A8 conditional-sum pivot (zero default) ->
    J2 left join to the best matches (fan-out per biome) -> P20 fill -> P21 row total."""
    li = T(spark, sf, "lineitem")
    des = li.select(F.col("l_orderkey").alias("cod_imovel"), X.year_of("l_shipdate").alias("ano"),
                    F.col("l_quantity").alias("area"), F.col("l_returnflag").alias("bioma"))
    tasks = fixtures.join_tasks(spark, sf)
    if tasks:  # one exchange by property for the distinct rows and the pivot, a bounded number of rows a task
        des = des.repartition(tasks, "cod_imovel")
    des = des.distinct()
    des = des.withColumn("bioma", X.capitalize("bioma"))
    piv = A.yearly_pivot(des, ["cod_imovel", "bioma"], "ano", "area", YEARS)
    best = best_matches(spark, sf, raw=M(spark, sf))
    dcols = [f"d{y}" for y in YEARS]
    j = best.join(piv, "cod_imovel", "left").fillna({c: 0.0 for c in dcols}) \
        .fillna({"bioma": NO_OVERLAP}).withColumnRenamed("bioma", "bioma_desmat") \
        .withColumn("d_total", X.row_sum(dcols))
    return j.groupBy("bioma_desmat").agg(F.count(F.lit(1)).alias("n"),
                                         *[F.round(F.sum(c), 2).alias(c) for c in dcols],
                                         F.round(F.sum("d_total"), 2).alias("d_total"))


@query("region_union", """
SELECT regiao AS regiao_tag, CAST(count(*) AS BIGINT) AS n, round(avg(indice), 6) AS avg_indice FROM matches GROUP BY 1
""")
def region_union(spark, sf):
    """S4 + X1: one sub-query per region of the region dimension and one for rows
    without a region, tagged with a literal and unioned."""
    m = M(spark, sf)
    # the dimension names the relations to read; it is as long as there are regions
    names = [r["r_name"] for r in T(spark, sf, "region").select("r_name").distinct().collect()]
    parts = {r: (lambda r=r: m.filter(F.col("regiao").eqNullSafe(F.lit(r))).select("indice")) for r in [*names, None]}
    u, _ = S.union_parts(parts, "regiao_tag")
    return u.groupBy("regiao_tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("indice"), "avg_indice"))


#: Rows of a CSV chunk: files of some hundred MB.
CSV_ROWS_PER_FILE = 5_000_000

_CSV_SCHEMA = ("cod_imovel bigint, estado string, regiao string, status_imovel string, "
               "data_cadastro_imovel string, area_a double, indice double, dono_igual string")


@query("csv_roundtrip", """
SELECT regiao, CAST(count(*) AS BIGINT) AS n, round(sum(area_a), 2) AS total_area,
       CAST(count_if(dono_igual) AS BIGINT) AS n_dono, CAST(count(indice) AS BIGINT) AS n_indice,
       CAST(count(try_cast(data_cadastro_imovel AS date)) AS BIGINT) AS n_datas
FROM raw_matches GROUP BY 1
""")
def csv_roundtrip(spark, sf):
    """S6 chunked CSV sink -> S1 CSV scan with explicit schema -> S2 typed override."""
    m = M(spark, sf).select("cod_imovel", "estado", "regiao", "status_imovel", "data_cadastro_imovel",
                            "area_a", "indice", F.col("dono_igual").cast("string").alias("dono_igual"))
    path = os.path.join(checkpoint_dir(spark), "matchlab-csv", uuid.uuid4().hex[:12])
    S.write_csv(m, path, max_records_per_file=CSV_ROWS_PER_FILE)
    back = S.with_types(S.read_csv(spark, path, _CSV_SCHEMA), {"dono_igual": "boolean"})
    return back.groupBy("regiao").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("area_a"), 2).alias("total_area"),
        F.count_if(F.col("dono_igual")).alias("n_dono"), F.count("indice").alias("n_indice"),
        F.count(X.year_from_text("data_cadastro_imovel")).alias("n_datas"))


@query("csv_switch", """
SELECT regiao, CAST(count(*) AS BIGINT) AS n, round(sum(area_a), 2) AS total_area FROM raw_matches GROUP BY 1
""")
def csv_switch(spark, sf):
    """A CSV table replaced by a new version in checked chunks, read through its manifest."""
    m = M(spark, sf).select("cod_imovel", "regiao", "area_a")
    path = os.path.join(checkpoint_dir(spark), "matchlab-csv", uuid.uuid4().hex[:12])
    S.replace_csv(m.where("area_a IS NULL"), path)
    S.replace_csv(m, path)
    back = S.read_current_csv(spark, path, "cod_imovel bigint, regiao string, area_a double")
    return back.groupBy("regiao").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_a"), 2).alias("total_area"))


@query("frame_sql", """
SELECT class_tam_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(pct), 6) AS avg_pct FROM (
  SELECT indice * 100 AS pct, class_tam_imovel FROM matches WHERE indice IS NOT NULL AND class_tam_imovel IS NOT NULL
) GROUP BY 1
""")
def frame_sql(spark, sf):
    """SQL over an in-memory DataFrame by name (``{df}`` reference, bound parameters)."""
    m = M(spark, sf)
    sel = spark.sql("SELECT indice * :scale AS pct, class_tam_imovel FROM {df} "
                    "WHERE indice IS NOT NULL AND class_tam_imovel IS NOT NULL", df=m, args={"scale": 100})
    return spark.sql("SELECT class_tam_imovel, count(*) AS n, round(avg(pct), 6) AS avg_pct "
                     "FROM {sel} GROUP BY class_tam_imovel", sel=sel)


@query("feature_join", """
SELECT n_name AS sigla, round(median(indice), 6) AS median_indice
FROM nation LEFT JOIN matches ON matches.estado = nation.n_name GROUP BY 1
""")
def feature_join(spark, sf):
    """Feature-collection JSON (one document, built from the state table)
    exploded to features and joined to the per-state median (A5)."""
    doc = S.feature_collection_json(T(spark, sf, "nation"), "n_name")
    path = os.path.join(checkpoint_dir(spark), "matchlab-geo", uuid.uuid4().hex[:12])
    doc.write.mode("overwrite").text(path)
    feats = S.read_features(spark, path, "sigla")
    med = A.group_median(M(spark, sf), ["estado"], "indice", "median_indice")
    j = feats.join(med, feats.sigla == med.estado, "left")
    return j.select("sigla", r6("median_indice"))


@query("feature_join_id", """
SELECT c_custkey AS id, round(median(indice), 6) AS median_indice
FROM customer LEFT JOIN matches ON matches.idt_municipio = c_custkey GROUP BY 1
""")
def feature_join_id(spark, sf):
    """S8 by properties.id: features of the places, as lines, joined to the median of each place."""
    path = os.path.join(checkpoint_dir(spark), "matchlab-geo", uuid.uuid4().hex[:12])
    S.write_feature_lines(T(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey")), path, "c_custkey")
    feats = S.read_feature_lines(spark, path)
    # a group per place, and places grow with the tables
    med = A.group_median(M(spark, sf), ["idt_municipio"], "indice", "median_indice", wide=True)
    return feats.join(med, feats["id"] == med["idt_municipio"], "left").select("id", r6("median_indice"))


@query("csv_blocks", """
SELECT local_txt, CAST(count(*) AS BIGINT) AS n, round(sum(area_a), 2) AS total_area, CAST(count(indice) AS BIGINT) AS n_indice
FROM (SELECT regiao || chr(10) || '"' || estado || '", ' || status_imovel AS local_txt, area_a, indice FROM raw_matches) GROUP BY 1
""")
def csv_blocks(spark, sf):
    """S1 + S6 with line breaks and quotes in values: rows found by quote parity over blocks."""
    text = F.concat("regiao", F.lit('\n"'), "estado", F.lit('", '), "status_imovel").alias("local_txt")
    path = os.path.join(checkpoint_dir(spark), "matchlab-csv", uuid.uuid4().hex[:12])
    S.write_csv(M(spark, sf).select("cod_imovel", text, "area_a", "indice"), path, max_records_per_file=CSV_ROWS_PER_FILE)
    back = B.read_csv_blocks(spark, path, "cod_imovel bigint, local_txt string, area_a double, indice double")
    return back.groupBy("local_txt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_a"), 2).alias("total_area"),
                                         F.count("indice").alias("n_indice"))


@query("feature_blocks", """
SELECT c_custkey AS id, CAST(count(cod_imovel) AS BIGINT) AS n, round(avg(indice), 6) AS avg_indice
FROM customer LEFT JOIN matches ON matches.idt_municipio = c_custkey GROUP BY 1
""")
def feature_blocks(spark, sf):
    """Feature collections as whole documents (braces and quotes in their strings), cut at
    feature borders by string state and depth over blocks, joined to the matches of each place."""
    places = T(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"),
                                             F.concat(F.lit('}{" '), "c_name").alias("nome"))
    path = os.path.join(checkpoint_dir(spark), "matchlab-geo", uuid.uuid4().hex[:12])
    S.write_feature_documents(places, path, "c_custkey", others=["nome"])
    feats = B.read_feature_blocks(spark, path)
    per = M(spark, sf).groupBy("idt_municipio").agg(F.count(F.lit(1)).alias("n"), F.avg("indice").alias("avg_indice"))
    j = feats.join(per, feats["id"] == per["idt_municipio"], "left")
    return j.select("id", F.coalesce("n", F.lit(0)).alias("n"), r6("avg_indice"))


@query("preview_rows", """
SELECT cod_imovel, linha, id_parte, id_vizinhanca FROM matches
ORDER BY cod_imovel, linha, id_parte, id_vizinhanca LIMIT 5
""")
def preview_rows(spark, sf):
    """O3 head(): first rows under an explicit total order (top-k, no full sort)."""
    return TK.preview(M(spark, sf).select("cod_imovel", "linha", "id_parte", "id_vizinhanca"), 5,
                      ["cod_imovel", "linha", "id_parte", "id_vizinhanca"])


@query("preview_sample", """
SELECT cod_imovel, linha, id_parte, id_vizinhanca, indice FROM matches
ORDER BY md5(concat_ws('|', CAST(cod_imovel AS VARCHAR), CAST(linha AS VARCHAR), CAST(id_parte AS VARCHAR), CAST(id_vizinhanca AS VARCHAR), '42')),
         cod_imovel, linha, id_parte, id_vizinhanca LIMIT 5
""")
def preview_sample(spark, sf):
    """O3 sample(n): seeded, recomputation-stable sample of 5 rows."""
    return TK.sample_rows(M(spark, sf).select("cod_imovel", "linha", "id_parte", "id_vizinhanca", "indice"),
                          5, 42, ["cod_imovel", "linha", "id_parte", "id_vizinhanca"])


@query("compact_numbers", extra_ctes="""
s AS (SELECT estado, sum(area_a) AS area, sum(CAST(round(area_a * 100) AS BIGINT)) AS area_cents, count(*) AS n
      FROM matches WHERE estado IS NOT NULL GROUP BY 1),
t AS (SELECT *, n * 100.0 / sum(n) OVER () AS pct FROM s)""", sql="""
SELECT estado,
       CASE WHEN area >= 1000000 THEN printf('%.1fM', area / 1000000) WHEN area >= 1000 THEN printf('%.1fK', area / 1000)
            ELSE printf('%.0f', area) END AS area_compact,
       CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0)
            ELSE printf('%.0f', CAST(n AS DOUBLE)) END AS n_compact,
       CASE WHEN area / 1000 >= 1000000 THEN printf('%.1f M ha', area / 1000 / 1000000)
            WHEN area / 1000 >= 1000 THEN printf('%.1f mil ha', area / 1000 / 1000)
            ELSE printf('%.0f ha', area / 1000) END AS area_units,
       printf('%.1f%%', pct) AS pct_txt,
       estado || ' (' || CAST(n AS VARCHAR) || ' - ' || printf('%.1f', pct) || '%)' AS label,
       CASE WHEN area >= 1000000 THEN printf('R$%.1fM', area / 1000000) WHEN area >= 1000 THEN printf('R$%.0fK', area / 1000)
            ELSE printf('R$%.0f', area) END AS area_currency,
       CASE WHEN n >= 1000000 THEN printf('%.1fMi', n / 1000000.0) WHEN n >= 1000 THEN printf('%.0fK', n / 1000.0)
            ELSE printf('%.0f', CAST(n AS DOUBLE)) END AS n_k,
       CASE WHEN n >= 1000000 THEN printf('%.1f M', n / 1000000.0) WHEN n >= 1000 THEN printf('%.0f K', n / 1000.0)
            ELSE printf('%.0f', CAST(n AS DOUBLE)) END AS n_spaced,
       printf('R$%,.0f', area_cents / 100.0) AS area_grouped,
       printf('%.0f%%', pct) AS pct0
FROM t
""")
def compact_numbers(spark, sf):
    """Compact K/M texts (several suffix / decimal variants, currency
    prefix), unit choice, percent suffix, thousands separators, 'label (n - p%)'."""
    # area_cents: the same total summed exactly in integer cents, so a total
    # ending in .50 rounds the same way on every engine and partitioning
    s = M(spark, sf).filter(F.col("estado").isNotNull()).groupBy("estado").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_a").alias("area"),
        F.sum(F.round(F.col("area_a") * 100).cast("long")).alias("area_cents"))
    tot = s.agg(F.sum("n").alias("_tot"))
    t = J.attach_one_row(s, tot).withColumn("pct", F.col("n") * 100.0 / F.col("_tot"))
    return t.select("estado", X.compact_number("area").alias("area_compact"),
                    X.compact_number("n").alias("n_compact"),
                    X.area_text(F.col("area") / 1000).alias("area_units"),
                    X.pct_text("pct").alias("pct_txt"),
                    X.count_share_text("estado", "n", "pct").alias("label"),
                    X.value_text("area", "currency").alias("area_currency"),
                    X.compact_number("n", k_decimals=0, m_suffix="Mi").alias("n_k"),
                    X.compact_number("n", k_decimals=0, k_suffix=" K", m_suffix=" M").alias("n_spaced"),
                    X.grouped_number(F.col("area_cents") / 100, 0, L.CURRENCY_PREFIX).alias("area_grouped"),
                    X.value_text("pct", "percent").alias("pct0"))
