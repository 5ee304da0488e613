from pyspark.sql import functions as F

from matchlab.sources import fixtures
from matchlab.streaming import refresh


def test_incremental_refresh_equals_batch(spark, tmp_path):
    raw = fixtures.raw_matches(spark, "/root/testdata/sf0.001")
    src = str(tmp_path / "raw")
    # two arrivals of raw files
    raw.filter(F.col("regiao") < "B").write.parquet(src, mode="append")
    raw.filter(F.col("regiao") >= "B").write.parquet(src, mode="append")
    table = str(tmp_path / "table")
    q = refresh.start_refresh(spark, src, raw.schema, table, name=f"t{abs(hash(str(tmp_path)))}")
    q.awaitTermination(300)
    got = spark.read.parquet(table)
    exp = fixtures.derive_matches(raw)
    cols = ["faixa_jaccard", "class_tam_imovel", "label_cpf"]
    g = {tuple(r[:-1]): r[-1] for r in got.groupBy(*cols).count().collect()}
    e = {tuple(r[:-1]): r[-1] for r in exp.groupBy(*cols).count().collect()}
    assert g == e and sum(g.values()) == raw.count()


def test_refresh_is_incremental_and_exactly_once(spark, tmp_path):
    raw = fixtures.raw_matches(spark, "/root/testdata/sf0.001")
    src = str(tmp_path / "raw2")
    table = str(tmp_path / "table2")
    name = f"inc{abs(hash(str(tmp_path)))}"
    raw.filter(F.col("regiao") == "AFRICA").write.parquet(src, mode="append")
    refresh.start_refresh(spark, src, raw.schema, table, name=name).awaitTermination(300)
    first = spark.read.parquet(table).count()
    # rerun with nothing new: the checkpoint prevents re-appending
    refresh.start_refresh(spark, src, raw.schema, table, name=name).awaitTermination(300)
    assert spark.read.parquet(table).count() == first
    # a new arrival is appended once
    raw.filter(F.col("regiao") != "AFRICA").write.parquet(src, mode="append")
    refresh.start_refresh(spark, src, raw.schema, table, name=name).awaitTermination(300)
    assert spark.read.parquet(table).count() == raw.count()
