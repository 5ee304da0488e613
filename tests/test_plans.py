"""Physical-plan properties the design relies on (checked with explain)."""

from pyspark.sql import functions as F

from matchlab.operators import aggregate as A
from matchlab.operators import joins as J
from matchlab.plans.common import M
from matchlab.plans.q_extract import best_matches

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_best_row_uses_partial_window_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(best_matches(spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p
    # the partial limit runs before the exchange on the key
    assert p.index("Exchange hashpartitioning(cod_imovel") < p.rindex("WindowGroupLimit")


def test_region_filter_prunes_partitions_and_columns(spark):
    m = M(spark, SF)
    q = m.filter(F.col("regiao").isin("ASIA", "EUROPE")).agg(F.avg("indice"))
    f = _formatted(q)
    pf = [ln for ln in f.splitlines() if ln.startswith("PartitionFilters")][0]
    assert "regiao" in pf and "IN (ASIA,EUROPE)" in pf
    read_schema = [ln for ln in f.splitlines() if ln.startswith("ReadSchema")][0]
    assert "indice" in read_schema and "area_b" not in read_schema


def test_simple_filters_are_pushed_to_parquet(spark):
    m = M(spark, SF)
    f = _formatted(m.filter(F.col("class_tam_imovel") == "Pequeno").agg(F.count(F.lit(1))))
    assert "PushedFilters: [IsNotNull(class_tam_imovel), EqualTo(class_tam_imovel,Pequeno)]" in f


def test_one_row_attach_is_a_scalar_subquery(spark):
    m = M(spark, SF)
    q = J.attach_one_row(m.select("indice"), m.agg(F.max("indice").alias("mx")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(q)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Subquery" in p and "Join" not in p and "CartesianProduct" not in p


def test_group_aggregates_are_partial_before_shuffle(spark):
    m = M(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(A.area_scorecard(m, ["estado"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "partial_avg" in p and p.index("Exchange") < p.rindex("partial_avg")
