"""Stand-in match tables built from the driver's TPC-H-ish parquet tables.

``raw_matches`` only maps driver columns onto the match-table schema (and
injects the nulls / bad dates / mixed boolean text the real data has); it
does none of the library's work.  ``matches`` then applies the library's
own derived-column step (``derive_matches``) to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from ..operators.derive import derive_matches
from ..operators.joins import equality_flag


INPUTS = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def place_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region; Spark broadcasts the small dimensions by their size."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(nr, c.c_nationkey == nr.n_nationkey)


#: Rows of a task that joins, derives, sorts and writes the fact table.
TASK_ROWS = 400_000


def join_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks of the last join, so that one holds about ``TASK_ROWS`` rows however long the tables are
    (counted in the footers; Spark takes its shuffle partitions if those are more); none for
    tables of a few tasks, whose orders Spark may broadcast."""
    n = -(-read_table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    return n if n > 4 else None


def raw_matches(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_tax", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cd = place_dim(spark, sf_dir)
    od = o.join(cd, o.o_custkey == cd.c_custkey)
    if tasks:  # orders last, so that the last stage begins with these two exchanges
        j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).repartition(tasks, "l_orderkey")
        od = od.repartition(tasks, "o_orderkey")
        j = j.join(od, j.l_orderkey == od.o_orderkey)
    else:
        j = (li.join(od, li.l_orderkey == od.o_orderkey)
             .join(p, li.l_partkey == p.p_partkey)
             .join(s, li.l_suppkey == s.s_suppkey))
    b = F.col("l_quantity") * F.col("p_retailprice")
    a = F.col("l_extendedprice")
    ln = F.col("l_linenumber")
    return j.select(
        F.col("l_orderkey").alias("cod_imovel"),
        ln.alias("linha"),
        F.col("l_partkey").alias("id_parte"),
        F.col("l_suppkey").alias("id_vizinhanca"),
        F.col("c_custkey").alias("idt_municipio"),
        F.expr("right(c_name, 3)").alias("municipio_nome"),
        F.col("n_name").alias("estado"),
        F.col("r_name").alias("regiao"),
        F.col("o_orderstatus").alias("status_imovel"),
        F.col("p_type").alias("tipo_imovel"),
        F.col("p_size").alias("num_modulo"),
        F.when(ln == 6, F.lit("31/12/1999"))
         .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("data_cadastro_imovel"),
        a.alias("area_a"),
        F.when((F.col("l_tax") == 0.08) & (ln == 5), F.lit(0.0)).otherwise(b).alias("area_b"),
        F.when(ln == 7, F.lit(None).cast("double"))
         .otherwise(F.least(a, b) / F.greatest(a, b)).alias("indice"),
        F.when(F.col("l_tax") == 0.07, F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "O",
               F.when(F.col("l_tax") < 0.03, F.lit("true")).otherwise(F.lit("1")))
         .otherwise(F.lit("False")).alias("igualdade_txt"),
        equality_flag("c_nationkey", "s_nationkey").alias("dono_igual"),  # P23
    )


def matches(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    return derive_matches(raw_matches(spark, sf_dir, tasks))


def owner_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The n:m owner bridge (property, owner), its owners and the parcels' owner codes: an order's
    customer owns it, and customer 1 every second order too, a third of the bridge; every
    seventh order has no owner and every tenth owner no code."""
    o = read_table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3")
    key = F.col("o_orderkey").alias("cod_imovel")
    bridge = o.select(key, F.col("o_custkey").alias("owner")).union(
        o.where("o_orderkey % 2 = 0 AND o_custkey <> 1").select(key, F.lit(1).cast("long")))
    owners = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("owner"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("owner_code"))
    parcels = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id_vizinhanca"), F.col("s_nationkey").alias("parcel_code"))
    return bridge, owners, parcels
