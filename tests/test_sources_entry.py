import os

import pytest
from pyspark.sql import functions as F

from matchlab.sources import files as S


def test_jdbc_options():
    o = S.jdbc_options("jdbc:postgresql://h/db", table="t", partition_column="id", lower_bound=1,
                       upper_bound=100, num_partitions=4)
    assert o["dbtable"] == "t" and o["numPartitions"] == "4" and o["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:x", query="select 1", table="t")
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:x", query="select 1", partition_column="id", lower_bound=0, upper_bound=1,
                       num_partitions=2)


def test_union_parts_skips_missing(spark, tmp_path):
    a = lambda: spark.createDataFrame([(1,)], "x int")
    bad = lambda: spark.read.parquet(str(tmp_path / "nope.parquet"))
    u, skipped = S.union_parts({"a": a, "bad": bad}, "part", optional=["bad"])
    assert [tuple(r) for r in u.collect()] == [(1, "a")] and skipped == ["bad"]


def test_csv_as_pandas_writes_it(spark, tmp_path):
    import pandas as pd
    rows = [(1, 'say "hi", ok', 1.5), (2, "a,b", None), (3, "line\nbreak", 2.0)]
    pd.DataFrame(rows, columns=["id", "t", "x"]).to_csv(tmp_path / "p.csv", index=False)
    back = S.read_csv(spark, str(tmp_path / "p.csv"), "id long, t string, x double", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == rows
    (tmp_path / "bad.csv").write_text("id,x\n1,2.5\nzwei,3\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|convert"):
        S.read_csv(spark, str(tmp_path / "bad.csv"), "id long, x double").collect()
    kept = S.read_csv(spark, str(tmp_path / "bad.csv"), "id long, x double", bad_rows=True).cache()
    assert [r[S.BAD_ROW] for r in kept.orderBy("x").collect()] == [None, "zwei,3"]


def test_materialized_follows_its_inputs(spark, tmp_path):
    from matchlab.sources import catalog
    src = str(tmp_path / "in")
    read = lambda: spark.read.schema("p string, x int").parquet(src)
    spark.createDataFrame([("01", 1), ("", 2)], "p string, x int").write.parquet(src)
    get = lambda: catalog.materialized(spark, "t", src, read, partition_by=("p",), inputs=(src,))
    assert dict(get().dtypes)["p"] == "string" and {r.p for r in get().where("x = 1").collect()} == {"01"}
    assert catalog.refresh(spark, "t") == []
    spark.createDataFrame([("02", 3)], "p string, x int").write.mode("append").parquet(src)
    assert get().count() == 2  # until a refresh is asked for
    assert catalog.refresh(spark, "t") == [src]
    assert get().count() == 3


def test_warm_table_starts_no_job(spark):
    from matchlab.plans.common import M
    M(spark, "/root/testdata/sf0.001")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("warm-table", "warm")
    M(spark, "/root/testdata/sf0.001").groupBy("estado").count()
    assert not tracker.getJobIdsForGroup("warm-table")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_csv_chunked_roundtrip(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2 == 0).cast("string").alias("flag"))
    p = S.write_csv(df.coalesce(1), str(tmp_path / "out"), max_records_per_file=30)
    files = [f for f in os.listdir(p) if f.endswith(".csv")]
    assert len(files) == 4
    back = S.with_types(S.read_csv(spark, p, "id long, flag string"), {"flag": "boolean"})
    assert back.filter("flag").count() == 50


def test_csv_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "id long, s string"
    old = spark.createDataFrame([(1, "old")], schema)
    new = spark.range(1000).select("id", F.concat(F.lit('a "quoted", value '), "id").alias("s")).repartition(3)
    with pytest.raises(FileNotFoundError):
        S.read_current_csv(spark, path, schema)
    S.replace_csv(old, path)
    real, sizes = S.write_csv, []

    def broken(df, to, rows, mode="overwrite"):
        """The first write breaks off, the second loses rows."""
        assert S.read_current_csv(spark, path, schema).collect() == old.collect()
        sizes.append(rows)
        if len(sizes) == 1:
            real(df.where("id < 10"), to, rows, mode)
            raise OSError("disk full")
        return real(df, to, rows, mode) if len(sizes) > 2 else [real(df, to, rows, mode), os.remove(next(
            os.path.join(to, f) for f in os.listdir(to) if f.startswith("part")))]
    monkeypatch.setattr(S, "write_csv", broken)
    with pytest.raises(OSError):
        S.replace_csv(new, path, chunks=(500, 300))
    assert S.read_current_csv(spark, path, schema).collect() == old.collect() and sizes == [500, 300]
    sizes.clear()
    folder = S.replace_csv(new, path, chunks=(500, 300, 100))
    assert sizes == [500, 300, 100] and len([f for f in os.listdir(folder) if f.endswith(".csv")]) >= 10
    assert sorted(S.read_current_csv(spark, path, schema).collect()) == sorted(new.collect())


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and df.columns[0] == "variant"
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_derive_replaces_existing_columns(spark):
    from matchlab.sources import fixtures
    raw = spark.createDataFrame(
        [("true", "2020-01-02", 0.9, 3, 10.0, 8.0, 1999)],
        "igualdade_txt string, data_cadastro_imovel string, indice double, num_modulo int, "
        "area_a double, area_b double, ano_cadastro int")
    d = fixtures.derive_matches(raw)
    assert d.columns.count("ano_cadastro") == 1
    r = d.collect()[0]
    assert r["ano_cadastro"] == 2020 and r["cpf_ok"] == 1 and r["faixa_jaccard"] == "85-100%"
    assert r["discrepancia"] == 25.0


def test_entry_schema_is_stable(spark):
    import __spark_entry__ as E
    a, b = E.entry(spark), E.entry(spark)
    assert a.dtypes == b.dtypes == [
        ("variant", "string"), ("total_records", "bigint"), ("avg_jaccard", "double"),
        ("median_jaccard", "double"), ("num_ufs", "bigint"), ("total_area", "double"), ("avg_cpf_ok", "double")]


def test_materialised_table_lives_in_session_checkpoint_dir(spark):
    from matchlab.plans.common import M
    from matchlab.session import checkpoint_dir
    conf = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if conf:
        assert d == conf
    files = M(spark, "/root/testdata/sf0.001").inputFiles()
    base = d.replace("file://", "").replace("file:", "")
    assert files and all(base in f for f in files)


def test_feature_collection_roundtrip(spark, tmp_path):
    feats = spark.createDataFrame([("AC",), ("SP",), ("RS",)], "uf string")
    p = str(tmp_path / "geo")
    S.feature_collection_json(feats, "uf").write.text(p)
    got = sorted(r["sigla"] for r in S.read_features(spark, p).collect())
    assert got == ["AC", "RS", "SP"]
