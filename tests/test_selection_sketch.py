"""Selection tables that prune the scan, and distinct counts from stored sketches."""

import glob

import pytest
from pyspark.sql import functions as F

from matchlab.operators import filters as FL
from matchlab.operators import sketches as SK


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(400).select((F.col("id") % 4).cast("int").alias("k"), F.concat(F.lit("R"), F.col("id") % 4).alias("regiao"),
                            F.concat(F.lit("m"), F.col("id") % 10).alias("municipio_nome"), "id").write.partitionBy("regiao").parquet(path)
    return spark.read.schema("k int, municipio_nome string, id long, regiao string").parquet(path), path


def test_selection_table_opens_only_its_folders(spark, facts):
    df, path = facts
    pick = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    for f in glob.glob(f"{path}/regiao=R3/*.parquet"):
        with open(f, "wb") as h:
            h.write(b"not parquet")
        with open(f.replace("/part", "/.part") + ".crc", "wb"):
            pass
    got = FL.isin_or_semijoin(df, "regiao", pick("R0", " R2 ", "", "R9"))
    assert got.columns == df.columns and {r.regiao: r.n for r in got.groupBy("regiao").agg(
        F.count("id").alias("n")).collect()} == {"R0": 100, "R2": 100}
    scans = [line for line in plan(got).splitlines() if "FileScan parquet" in line and path[-30:] in line]
    # one scan, printed in the final and in the initial plan
    assert len(scans) == 2 and all("ubquery" in line.split("PartitionFilters:")[1] for line in scans)
    with pytest.raises(Exception):
        FL.isin_or_semijoin(df, "regiao", pick("R3")).agg(F.sum("id")).collect()


def test_selection_tables_of_any_length(spark, facts, monkeypatch):
    df, _ = facts
    ids = lambda n: spark.range(n).select(F.col("id").cast("string").alias("v"))
    for few in (0, 3, 200):  # the join alone, the mixture, the array alone
        monkeypatch.setattr(FL, "FEW_VALUES", few)
        assert FL.isin_or_semijoin(df, "id", ids(7)).count() == 7
        assert FL.isin_or_semijoin(df, "id", ids(1000)).count() == 400
        assert FL.isin_or_semijoin(df, "id", ids(0)).count() == 400
        assert FL.isin_or_semijoin(df, "id", spark.createDataFrame([("x",), (None,)], "v string")).count() == 0
        assert FL.isin_or_semijoin(df, "id", spark.createDataFrame([(" ",), (None,)], "v string")).count() == 400
        sel = spark.createDataFrame([("m1",), ("m1 - 1",), ("m2 - 0",), ("m2 - 2",), ("m2 - 2",), (" ",), (None,)], "place string")
        rows = FL.place_filter_from_table(df.withColumn("estado", F.col("k").cast("string")), sel)
        assert sorted(r.id for r in rows.collect()) == [i for i in range(400) if i % 10 == 1 or i % 10 == 2 and i % 4 in (0, 2)]
        assert FL.place_filter_from_table(df.withColumn("estado", F.lit("x")), sel.where("false")).count() == 400


def test_empty_selection_keeps_null_rows(spark):
    df = spark.createDataFrame([(None,), ("a",)], "estado string")
    none = spark.createDataFrame([], "v string")
    assert FL.isin_or_semijoin(df, "estado", none).count() == 2
    assert FL.isin_or_semijoin(df, "estado", df).count() == 1


def test_sketches_merge_under_any_filter(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("car"), (F.col("id") % 7).alias("place"),
                                      F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("year"))
    rows = rows.unionByName(rows.limit(10).withColumn("car", F.lit(None).cast("long")))
    sk = SK.distinct_sketches(rows, "car", ["place", "year"])
    for where in (None, F.col("year") > 2, F.col("place") == 3, F.col("year").isNull()):
        part = rows if where is None else rows.where(where)
        for by in ([], ["place"], ["year"]):
            want = {tuple(r)[:-1]: r.n for r in part.groupBy(*by).agg(F.countDistinct("car").alias("n")).collect()}
            got = {tuple(r)[:-1]: r.n for r in SK.merged_distinct(sk, by, where, "n").collect()}
            assert set(got) == set(want)
            assert all(abs(got[k] - want[k]) <= SK.error_bound() * want[k] for k in want)
    assert SK.merged_distinct(sk, where=F.lit(False)).first()[0] == 0


def test_stored_sketches_answer_without_the_facts(spark):
    from matchlab.plans.common import M, property_sketches
    sf = "/root/testdata/sf0.001"
    q = SK.merged_distinct(property_sketches(spark, sf), ["estado"], F.col("regiao") == "ASIA")
    facts, stored = set(M(spark, sf).inputFiles()), set(q.inputFiles())
    assert stored and not facts & stored
