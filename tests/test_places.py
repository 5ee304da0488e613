"""Queries by place on tables of their own: as many groups as there are places."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from matchlab.operators import joins, ranks
from matchlab.plans.q_extract import feature_join_id, yearly_pivot
from matchlab.sources import fixtures

PLACES = 120


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """PLACES customers, two orders of each third one and one of the others, four lines an order."""
    d = str(tmp_path_factory.mktemp("places"))
    n = F.col("id")
    orders = spark.range(PLACES * 2).where("id < 120 OR id % 3 = 0")
    lines = orders.select(n.alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    out = {
        "region": spark.range(2).select(n.cast("int").alias("r_regionkey"), F.concat(F.lit("REGION_"), n).alias("r_name")),
        "nation": spark.range(5).select(n.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), n).alias("n_name"),
                                        (n % 2).cast("int").alias("n_regionkey")),
        "customer": spark.range(PLACES).select(n.alias("c_custkey"), F.format_string("Customer#%09d", n).alias("c_name"),
                                               (n % 5).cast("int").alias("c_nationkey")),
        "supplier": spark.range(7).select(n.alias("s_suppkey"), (n % 5).cast("int").alias("s_nationkey")),
        "part": spark.range(11).select(n.alias("p_partkey"), F.lit("TYPE").alias("p_type"), (n + 1).cast("int").alias("p_size"),
                                       (n * 10.0 + 5).alias("p_retailprice")),
        "orders": orders.select(n.alias("o_orderkey"), (n % PLACES).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                                F.to_timestamp(F.lit("1996-01-02")).alias("o_orderdate")),
        "lineitem": lines.select("l_orderkey", (F.col("l_orderkey") % 11).alias("l_partkey"), (F.col("l_orderkey") % 7).alias("l_suppkey"),
                                 F.col("l_linenumber").cast("int").alias("l_linenumber"),
                                 ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 101 + 1.0).alias("l_extendedprice"),
                                 F.lit(2.0).alias("l_quantity"), F.lit(0.01).alias("l_tax"), F.lit("O").alias("l_linestatus")),
    }
    for name, df in out.items():
        df.write.parquet(f"{d}/{name}.parquet")
    return d


def test_median_of_more_places_than_may_be_broadcast(spark, tables, monkeypatch):
    monkeypatch.setattr(ranks, "few", lambda d: joins.few(d, PLACES))
    want = {}
    for r in spark.read.parquet(f"{tables}/lineitem.parquet").collect():
        a, b = r.l_extendedprice, r.l_quantity * (r.l_partkey * 10.0 + 5)
        want.setdefault(r.l_orderkey % PLACES, []).append(min(a, b) / max(a, b))
    got = {r.id: r.median_indice for r in feature_join_id(spark, tables).collect()}
    assert got == {k: pytest.approx(median(v), abs=1e-6) for k, v in want.items()} and len(got) == PLACES


def test_fact_table_tasks_follow_its_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 40)
    n = fixtures.join_tasks(spark, tables)
    assert n == -(-160 * 4 // 40) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain, dealt = fixtures.matches(spark, tables), fixtures.matches(spark, tables, n)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and dealt.columns == plain.columns
    assert max(len(rows) for rows in dealt.rdd.glom().collect()) < 4 * 40
    monkeypatch.setattr(fixtures, "TASK_ROWS", 400)
    assert fixtures.join_tasks(spark, tables) is None


def test_pivot_tasks_follow_the_rows(spark, tables, monkeypatch):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("N")) \
        .withColumn("l_shipdate", F.to_timestamp(F.concat((F.col("l_orderkey") % 3 + 1995).cast("string"), F.lit("-05-05"))))
    lines = lines.withColumn("l_quantity", F.col("l_linenumber").cast("double")).cache()
    read = lambda spark, sf, name: lines if name == "lineitem" else spark.read.parquet(f"{sf}/{name}.parquet")
    monkeypatch.setattr(fixtures, "read_table", read)
    plain = yearly_pivot(spark, tables).collect()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 40)
    dealt = yearly_pivot(spark, tables)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain)) and {r.bioma_desmat for r in plain} == {"A", "N"}
    assert sum(r.n for r in plain) == 160 and sum(r.d_total for r in plain) == 160 * 10
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
