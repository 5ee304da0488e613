"""The table bucketed by key, with its hot keys apart."""

from pyspark.sql import functions as F

from matchlab.operators import windows as WN
from matchlab.sources import catalog


def rows(spark):
    """Key 7 holds a third of the rows, a sixth has no key."""
    n = F.col("id")
    key = F.when(n % 6 < 2, F.lit(7)).when(n % 6 == 2, F.lit(None)).otherwise(n % 500)
    return spark.range(6000).select(key.cast("long").alias("k"), (n * 7919 % 6007).alias("x"), n.alias("i"))


def operator(t):
    best = WN.best_per_key(t, "k", [F.col("x").desc(), F.col("i")])
    per = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return best.join(per.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k"))).select("k", "x", "i", "n")


def test_parts_are_the_table(spark):
    df = rows(spark)
    t = catalog.co_located(spark, "colocated-test", "a", lambda: rows(spark), "k", buckets=8)
    assert {r.k for r in t.hot.select("k").distinct().collect()} == {7, None}
    assert t.hot.intersect(t.even).count() == 0
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(t.even.unionByName(t.hot).collect(), key=key) == sorted(df.collect(), key=key)
    assert sorted(t.per_key(operator).collect(), key=key) == sorted(operator(df).collect(), key=key)
    # a bucket has no more rows than its share and a few keys
    assert max(r[1] for r in t.even.groupBy(F.pmod(F.hash("k"), F.lit(8))).count().collect()) < 2 * 3000 / 8
    assert catalog.co_located(spark, "colocated-test", "a", lambda: 1 / 0, "k") is t
    empty = catalog.co_located(spark, "colocated-test", "none", lambda: rows(spark).where("false"), "k", buckets=8)
    assert empty.per_key(operator).count() == 0


def test_no_exchange_on_the_bucketed_part(spark):
    t = catalog.co_located(spark, "colocated-test", "b", lambda: rows(spark), "k")
    other = catalog.write_bucketed(spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g")), "other", "k", t.buckets)[1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = WN.best_per_key(t.even, "k", [F.col("x").desc(), F.col("i")])
        j = best.join(t.even.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k").join(other, "k")
        assert j.count() > 400
        text = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
