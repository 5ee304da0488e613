"""Filter queries (F1-F11, P27/P28 place names)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import filters as FL
from ..operators import windows as WN
from .common import M, T
from .registry import query, r6

# Stand-in selections (nation names play states, region names play regions).
AFRICA_STATES = ["NATION_0", "NATION_5", "NATION_10", "NATION_15", "NATION_20"]
STATE_SELECTION = AFRICA_STATES + ["NATION_1", "NATION_6"]
_STATES_SQL = ", ".join(f"'{s}'" for s in STATE_SELECTION)


@query("filter_dims", """
SELECT regiao, class_tam_imovel, status_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(indice), 6) AS avg_indice
FROM matches
WHERE regiao IN ('AMERICA','ASIA') AND class_tam_imovel IN ('Pequeno','Médio') AND status_imovel IN ('F','O')
  AND indice IS NOT NULL
GROUP BY ALL
""")
def filter_dims(spark, sf):
    """F1 IN-lists with blanks removed, F4 empty lists ignored, F5 NOT NULL."""
    spec = FL.FilterSpec.of(regions=["AMERICA", " ", "ASIA", None], sizes=["Pequeno", "Médio", ""],
                            statuses=["F", "O"], states=[])
    d = FL.not_null(spec.apply(M(spark, sf)), ["indice"])
    return (d.groupBy("regiao", "class_tam_imovel", "status_imovel")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("indice"), "avg_indice")))


@query("filter_precedence", f"""
SELECT 'place' AS variant, CAST(count(*) AS BIGINT) AS n FROM matches
 WHERE (municipio_nome IN ('007', '123') OR (municipio_nome = '045' AND estado = 'NATION_5'))
UNION ALL
SELECT 'state' AS variant, CAST(count(*) AS BIGINT) AS n FROM matches WHERE estado IN ({_STATES_SQL})
UNION ALL
SELECT 'region' AS variant, CAST(count(*) AS BIGINT) AS n FROM matches WHERE regiao IN ('EUROPE')
UNION ALL
SELECT 'none' AS variant, CAST(count(*) AS BIGINT) AS n FROM matches
""")
def filter_precedence(spark, sf):
    """place beats state beats region; F4: an empty spec is TRUE."""
    m = M(spark, sf)
    specs = {
        "place": FL.FilterSpec.of(regions=["EUROPE"], states=STATE_SELECTION,
                                  places=["007", "123", "045 - NATION_5"]),
        "state": FL.FilterSpec.of(regions=["EUROPE"], states=STATE_SELECTION),
        "region": FL.FilterSpec.of(regions=["EUROPE"]),
        "none": FL.FilterSpec.of(),
    }
    out = None
    for name, spec in specs.items():
        part = spec.resolved().apply(m).agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit(name).alias("variant"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("place_filter", """
SELECT municipio_nome, estado, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE municipio_nome IN ('007', '777') OR (municipio_nome = '123' AND estado = 'NATION_12')
   OR (municipio_nome = 'a - b' AND estado = 'NATION_1')
GROUP BY ALL
""")
def place_filter(spark, sf):
    """F2 + P28: bare and qualified place names, split on the last ' - '."""
    spec = FL.FilterSpec.of(places=["007", "123 - NATION_12", " 777 ", "a - b - NATION_1"])
    return (spec.apply(M(spark, sf)).groupBy("municipio_nome", "estado")
            .agg(F.count(F.lit(1)).alias("n")))


@query("range_filter", """
SELECT class_tam_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(discrepancia), 6) AS avg_disc
FROM matches WHERE discrepancia BETWEEN -100 AND 100 AND status_imovel != 'P' GROUP BY 1
""")
def range_filter(spark, sf):
    """F6 closed range (discrepancy window), F7 inequality."""
    d = M(spark, sf).filter(FL.in_range("discrepancia", -100.0, 100.0) & (F.col("status_imovel") != "P"))
    return d.groupBy("class_tam_imovel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("discrepancia"), "avg_disc"))


@query("drop_null_subset", """
SELECT regiao, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE indice IS NOT NULL AND igualdade_txt IS NOT NULL AND ano_cadastro IS NOT NULL GROUP BY 1
""")
def drop_null_subset(spark, sf):
    """F8: drop rows with a null in any column of a subset."""
    d = FL.not_null(M(spark, sf), ["indice", "igualdade_txt", "ano_cadastro"])
    return d.groupBy("regiao").agg(F.count(F.lit(1)).alias("n"))


@query("guarded_group", """
SELECT municipio_nome, round(median(indice), 6) AS median, CAST(count(*) AS BIGINT) AS n
FROM matches WHERE municipio_nome IS NOT NULL GROUP BY 1 HAVING count(*) >= 60
""")
def guarded_group(spark, sf):
    """F9 per group: the group median only where the group has at least 60 rows."""
    m = M(spark, sf)
    n = A.group_size(m, ["municipio_nome"], "n").filter(F.col("n") >= 60)
    med = A.group_median(m, ["municipio_nome"], "indice", "median")
    return n.join(med, "municipio_nome", "left").select("municipio_nome", r6("median"), "n")


@query("guarded_total", """
SELECT estado, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE regiao = 'AFRICA' AND (SELECT count(*) FROM matches WHERE regiao = 'AFRICA') >= 10
GROUP BY 1
""")
def guarded_total(spark, sf):
    """F9 whole-table: the result only when the filtered input has >= 10 rows (no driver count)."""
    d = FL.guard_min_rows(FL.FilterSpec.of(regions=["AFRICA"]).apply(M(spark, sf)), 10)
    return d.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


_COMPLETE_SQL = f"""
SELECT regiao FROM (SELECT DISTINCT regiao, estado FROM matches WHERE regiao IS NOT NULL AND estado IS NOT NULL)
GROUP BY regiao HAVING bool_and(estado IN ({_STATES_SQL}))"""


def _selected_states(spark):
    return spark.createDataFrame([(s,) for s in STATE_SELECTION], "estado string")


@query("complete_groups", _COMPLETE_SQL)
def complete_groups(spark, sf):
    """Regions all of whose states are in the selection (relational division)."""
    m = M(spark, sf)
    membership = m.select("regiao", "estado").filter(F.col("regiao").isNotNull() & F.col("estado").isNotNull())
    return FL.complete_groups(membership, _selected_states(spark), "regiao", "estado")


def _panorama_sql(regions: str, sizes: str, states: str) -> str:
    """Rows of the regions (a condition), or the filtered rows if there are none."""
    return f"""
SELECT regiao, faixa_jaccard, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE {regions} AND class_tam_imovel IN ({sizes}) GROUP BY ALL
UNION ALL
SELECT regiao, faixa_jaccard, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE estado IN ({states}) AND class_tam_imovel IN ({sizes})
  AND NOT EXISTS (SELECT 1 FROM matches WHERE {regions} AND class_tam_imovel IN ({sizes}))
GROUP BY ALL
"""


def _panorama(spark, sf, states, sizes, regions=()):
    spec = FL.FilterSpec.of(states=states, sizes=sizes, regions=regions)
    n, r = T(spark, sf, "nation"), T(spark, sf, "region")
    dim = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("regiao"), F.col("n_name").alias("estado"))
    rows = FL.context_rows(M(spark, sf), spec, dim)
    return rows.groupBy("regiao", "faixa_jaccard").agg(F.count(F.lit(1)).alias("n"))


_SIZES = ["Pequeno", "Médio", "Grande"]
_SIZES_SQL = "'Pequeno','Médio','Grande'"
_DIM_COMPLETE_SQL = """SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name HAVING bool_and(n_name IN ({states}))"""
_TWO_STATES = ["NATION_1", "NATION_2"]


@query("context_panorama", _panorama_sql(f"regiao IN ({_DIM_COMPLETE_SQL.format(states=_STATES_SQL)})", _SIZES_SQL, _STATES_SQL))
def context_panorama(spark, sf):
    """F11, some region complete: region x band of the complete regions."""
    return _panorama(spark, sf, STATE_SELECTION, _SIZES)


@query("context_panorama_none", _panorama_sql("true", "'Grande'", "'NATION_1','NATION_2'"))
def context_panorama_none(spark, sf):
    """F11, no region complete: no region filter, all regions."""
    return _panorama(spark, sf, _TWO_STATES, ["Grande"])


@query("context_panorama_regions", _panorama_sql("regiao IN ('EUROPE')", _SIZES_SQL, _STATES_SQL))
def context_panorama_regions(spark, sf):
    """F11, explicit regions: they are used alone, whatever states are selected."""
    return _panorama(spark, sf, STATE_SELECTION, _SIZES, ["EUROPE"])


@query("context_panorama_empty", """
SELECT regiao, faixa_jaccard, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE estado IN ('NATION_1','NATION_2') AND class_tam_imovel IN ('Pequeno','Médio','Grande') GROUP BY ALL
""")
def context_panorama_empty(spark, sf):
    """F11, nothing left after the relaxation (a region without rows): the filtered rows."""
    m = M(spark, sf)
    spec = FL.FilterSpec.of(states=_TWO_STATES, sizes=_SIZES, regions=["ANTARCTICA"])
    rows = FL.context_rows(m, spec, m.select("regiao", "estado").limit(0))
    return rows.groupBy("regiao", "faixa_jaccard").agg(F.count(F.lit(1)).alias("n"))


@query("qualified_places", extra_ctes="""
p AS (SELECT municipio_nome, estado, count(DISTINCT estado) OVER (PARTITION BY municipio_nome) AS n_ufs
      FROM (SELECT DISTINCT municipio_nome, estado FROM matches WHERE municipio_nome IS NOT NULL))""", sql="""
SELECT CASE WHEN n_ufs > 1 THEN municipio_nome || ' - ' || estado ELSE municipio_nome END AS place,
       CAST(n_ufs AS BIGINT) AS n_ufs
FROM p
""")
def qualified_places(spark, sf):
    """P27 + W2: 'name - UF' for names present in more than one state."""
    return WN.qualified_places(M(spark, sf), "municipio_nome", "estado")


@query("dimension_catalog", extra_ctes="""
p AS (SELECT municipio_nome, estado, count(DISTINCT estado) OVER (PARTITION BY municipio_nome) AS n_ufs
      FROM (SELECT DISTINCT municipio_nome, estado FROM matches WHERE municipio_nome IS NOT NULL))""", sql="""
SELECT DISTINCT 'regiao' AS dimension, regiao AS value FROM matches WHERE regiao IS NOT NULL
UNION ALL SELECT DISTINCT 'estado', estado FROM matches WHERE estado IS NOT NULL
UNION ALL SELECT DISTINCT 'class_tam_imovel', class_tam_imovel FROM matches WHERE class_tam_imovel IS NOT NULL
UNION ALL SELECT DISTINCT 'status_imovel', status_imovel FROM matches WHERE status_imovel IS NOT NULL
UNION ALL SELECT 'municipio', CASE WHEN n_ufs > 1 THEN municipio_nome || ' - ' || estado ELSE municipio_nome END FROM p
""")
def dimension_catalog(spark, sf):
    """Sorted distinct values of the filter dimensions, place names included."""
    m = M(spark, sf)
    dims = WN.dimension_catalog(m, ["regiao", "estado", "class_tam_imovel", "status_imovel"])
    places = WN.qualified_places(m, "municipio_nome", "estado").select(F.lit("municipio").alias("dimension"), F.col("place").alias("value"))
    return dims.unionByName(places).orderBy("dimension", "value")


@query("place_selection_table", """
SELECT estado, municipio_nome, CAST(count(*) AS BIGINT) AS n FROM matches
WHERE municipio_nome IN ('007', '777') OR (municipio_nome = '123' AND estado = 'NATION_12') GROUP BY ALL
""")
def place_selection_table(spark, sf):
    """F2 with the selection in a table of qualified and bare names (semi-join)."""
    sel = spark.createDataFrame([("007",), ("123 - NATION_12",), ("777",)], "place string")
    return FL.place_filter_from_table(M(spark, sf), sel).groupBy("estado", "municipio_nome").agg(F.count(F.lit(1)).alias("n"))


@query("state_selection_table", """
SELECT estado, CAST(count(*) AS BIGINT) AS n FROM matches WHERE estado IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY 1
""")
def state_selection_table(spark, sf):
    """F1 with the selection in a table."""
    chosen = T(spark, sf, "nation").where("n_regionkey = 1").select("n_name")
    return FL.isin_or_semijoin(M(spark, sf), "estado", chosen).groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


@query("region_selection_table", """
SELECT regiao, class_tam_imovel, CAST(count(*) AS BIGINT) AS n, round(avg(indice), 6) AS avg_indice FROM matches
WHERE regiao IN (SELECT r_name FROM region WHERE r_regionkey IN (1, 3)) GROUP BY ALL
""")
def region_selection_table(spark, sf):
    """F1 with a table of regions: the scan opens the folders of those regions only."""
    chosen = T(spark, sf, "region").where("r_regionkey IN (1, 3)").select("r_name")
    return FL.isin_or_semijoin(M(spark, sf), "regiao", chosen).groupBy("regiao", "class_tam_imovel").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("indice"), "avg_indice"))


@query("empty_selection_table", """
SELECT estado, CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY 1
""")
def empty_selection_table(spark, sf):
    """selection tables without values filter nothing."""
    none = T(spark, sf, "nation").where("n_regionkey < 0").select(F.col("n_name").alias("place"))
    rows = FL.place_filter_from_table(FL.isin_or_semijoin(M(spark, sf), "regiao", none), none)
    return rows.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
