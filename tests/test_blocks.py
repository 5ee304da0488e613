"""Records read in byte ranges, against the readers that take a whole file in one task."""

import json
import random

import pandas as pd
import pytest

from matchlab.sources import blocks as B
from matchlab.sources import files as S

TEXTS = ["plain", 'say "hi", ok', "line\nbreak", "", "{", "}", '"', '\\', "a\r\nb", '}\n"{', "x" * 700, '\\"}', "\n\n", "é{ü}"]


@pytest.fixture
def small_blocks(spark):
    """Byte ranges of 256: records cross the borders, and some are longer than a range."""
    conf = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(seed, n):
    r = random.Random(seed)
    return [(i, "".join(r.choices(TEXTS, k=r.randint(1, 3))) + "|", r.choice([None, i / 4])) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_blocks(small_blocks, tmp_path, end):
    spark, schema = small_blocks, "id long, t string, x double"
    want = []
    for k in range(2):
        rows = [(i + 1000 * k, t, x) for i, t, x in table(k, 60)]
        want += rows
        pd.DataFrame(rows, columns=["id", "t", "x"]).to_csv(tmp_path / f"p{k}.csv", index=False, lineterminator=end)
    got = B.read_csv_blocks(spark, str(tmp_path), schema)
    assert B._pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect())) == want
    whole = S.read_csv(spark, str(tmp_path), schema, multi_line=True)
    if end == "\r\n":  # Spark's reader makes \r\n in values \n where rows end so; the blocks keep the text
        want = [(i, t.replace("\r\n", "\n"), x) for i, t, x in want]
    assert sorted(map(tuple, whole.collect())) == want


def test_csv_blocks_edges(small_blocks, tmp_path):
    spark = small_blocks
    read = lambda text, **k: (
        (tmp_path / "t.csv").write_text(text), [tuple(r) for r in B.read_csv_blocks(
            spark, str(tmp_path / "t.csv"), "a string, b long", **k).orderBy("b").collect()])[1]
    assert read("") == [] and read("a,b\n") == []
    assert read('"a\nhead",b\n\nx,1\n\ny,2') == [("x", 1), ("y", 2)]  # no line end, empty lines, a broken header
    assert read('"",1\n,2\n', header=False) == [(None, 1), (None, 2)]
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "t.csv"), "a string, b long", header=False,
                                        multi_line=True).collect()), key=str) == [(None, 1), (None, 2)]
    assert read('a,b\n"' + "long\n" * 2000 + '",1\nx,2\n') == [("long\n" * 2000, 1), ("x", 2)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read("a,b\nx,notanumber\n")


@pytest.mark.parametrize("indent", [None, 2])
def test_feature_blocks(small_blocks, tmp_path, indent):
    spark, want = small_blocks, []
    for k in range(2):
        feats = []
        for i, t, x in table(10 + k, 50):
            feats.append({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[i, 1.5], [2, 3]]], "n": {}},
                          "properties": {t: t, "id": i + 1000 * k, "nome": t, "deep": {"a": {"b": [{}, {"c": t}]}}}})
            want.append(i + 1000 * k)
        doc = {"type": "FeatureCollection", "name": 'odd "}{ name', "crs": {"type": "name", "properties": {"name": "}"}},
               "features": feats, "links": [{"type": "link", "properties": {"id": 7}}], "note": "}{"}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)) + "\n" * k)
    assert B._pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 20
    assert sorted(r.id for r in B.read_feature_blocks(spark, str(tmp_path)).collect()) == want
    whole = S.read_features(spark, str(tmp_path), "id")
    assert sorted(int(r.id) for r in whole.collect()) == want


def test_feature_blocks_edges(small_blocks, tmp_path):
    spark, path = small_blocks, tmp_path / "f.json"
    read = lambda text: (path.write_text(text), sorted((r.id for r in B.read_feature_blocks(spark, str(path), kind="string").collect()), key=str))[1]
    assert read("") == [] and read('{"type":"FeatureCollection","features":[]}') == []
    assert read('{"features":[{"type":"Feature"},{"type":"Feature","properties":{"id":null}},'
                '{"type":"Feature","properties":{"id":"\\\\\\"}"}}]}') == [None, None, '\\"}']
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read('{"features":[{"type":"Feature",,"properties":{}}]}')


def test_csv_records_inside_a_block_are_not_shuffled(small_blocks, tmp_path):
    """Borders of Arrow batches within and between blocks; only records that cross blocks stay open."""
    spark = small_blocks
    rows = table(5, 80)
    for k in range(3):
        pd.DataFrame(rows, columns=["id", "t", "x"]).to_csv(tmp_path / f"p{k}.csv", index=False)
    pieces = B._pieces(spark, str(tmp_path), "\n").withColumn("_quotes", B._count(B.F.col("value"), '"'))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = B.csv_records(spark, str(tmp_path)).collect()
        first = [r.text for r in got if r["first"]]
        assert first == ["id,t,x"] * 3 and len(got) == 3 * 81
        assert sorted(map(tuple, B.read_csv_blocks(spark, str(tmp_path), "id long, t string, x double").collect())) == sorted(rows * 3)
        open_ = pieces.where("_block = 0").withColumn("_carry", B.F.lit(0).cast("long")).select(
            "_file", "_block", "_row", "value", "_quotes", "_carry").mapInArrow(B._joined, B._JOINED).groupBy("_whole").count().collect()
        n = {r._whole: r["count"] for r in open_}
        assert n[False] == 3 and n[True] > 30  # each file's first block leaves one record open
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
