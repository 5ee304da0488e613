"""Scans and sinks.

Readers take explicit schemas (no inference pass over the data); sinks
write in parallel with ``maxRecordsPerFile`` as the chunk size.  A relational
database is read through Spark's JDBC source with partitioned reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.topk import union_all


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, multi_line: bool = False, bad_rows: bool = False) -> DataFrame:
    """CSV with header; an explicit schema avoids an inference pass
    (``inferSchema`` only when no schema is given).

    Quotes inside a quoted value are doubled, as pandas writes them. Values with
    line breaks need ``multi_line``, which reads each file in one task. A row that
    doesn't fit the schema fails the read; with ``bad_rows`` it is kept, with its
    line in the column ``_bad_row``."""
    r = spark.read.option("header", header).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return r.option("mode", "PERMISSIVE" if bad_rows else "FAILFAST").option(
            "columnNameOfCorruptRecord", BAD_ROW).schema(_with_bad(schema, bad_rows)).csv(path)
    return r.option("inferSchema", True).csv(path)


BAD_ROW = "_bad_row"


def _with_bad(schema, bad_rows: bool):
    if not bad_rows:
        return schema
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    return s.add(BAD_ROW, "string")


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per-column type override applied with try_cast (bad text -> NULL)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def write_csv(df: DataFrame, path: str, max_records_per_file: int | None = None,
              mode: str = "overwrite") -> str:
    """CSV sink with header, no index, chunked by ``maxRecordsPerFile``.

    Writing to a new path and switching readers to it (instead of overwriting
    the table being read) keeps a failed job from destroying its own input."""
    w = df.write.mode(mode).option("header", True).option("escape", '"')
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.csv(path)
    return path


#: Rows of a chunk, and of the smaller ones that a failed write is tried with again.
CSV_CHUNKS = (5_000_000, 1_000_000, 200_000)


def replace_csv(df: DataFrame, path: str, chunks: Sequence[int] = CSV_CHUNKS, multi_line: bool = False) -> str:
    """A new version of the CSV table at ``path``, with retry and switch. Returns its folder.

    The version is written to a folder of its own, in chunks of ``chunks[0]`` rows; its rows are
    read back and compared with the rows that went in. A write that fails, or doesn't
    compare, is tried again in the next smaller chunks, in another folder. Then one line
    is added to the manifest, which ``read_current_csv`` follows: readers see the old version, whole,
    until then, and also if no size works (the last error is raised)."""
    spark = df.sparkSession
    version = _versions(spark, path) + 1
    for k, rows in enumerate(chunks):
        folder = f"data-{uuid.uuid4().hex}"
        try:
            seen = Observation()
            write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{folder}", rows, mode="errorifexists")
            there = read_csv(spark, f"{path}/{folder}", df.schema, multi_line=multi_line).count()
            if there != seen.get["rows"]:
                raise OSError(f"{path}/{folder} has {there} rows of {seen.get['rows']}")
            break
        except (PySparkException, Py4JError, OSError):
            if k + 1 == len(chunks):
                raise
    line = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(there).alias("rows")))
    spark.range(1, numPartitions=1).select(line.alias("value")).write.mode("append").text(f"{path}/manifest")
    return f"{path}/{folder}"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long, folder string, rows long").json(f"{path}/manifest")
    except AnalysisException:  # no version yet
        return None


def _versions(spark: SparkSession, path: str) -> int:
    m = _manifest(spark, path)
    return (m.agg(F.max("version")).first()[0] or 0) if m is not None else 0


def read_current_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """The version that the manifest of ``path`` names last."""
    m = _manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"{path} has no manifest")
    folder = m.agg(F.max_by("folder", "version")).first()[0]
    return read_csv(spark, f"{path}/{folder}", schema, multi_line=multi_line)


def jdbc_options(url: str, query: str | None = None, table: str | None = None, user: str | None = None,
                 password: str | None = None, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None,
                 num_partitions: int | None = None, fetch_size: int = 10000) -> dict:
    """S3: options of a JDBC read by query or table.  A partition column with
    bounds splits the read into ``num_partitions`` parallel range queries."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query / table")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition_column is not None:
        if table is None:
            raise ValueError("partitioned reads need dbtable (Spark rejects query + partitionColumn)")
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


def read_jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    """S3: relational scan through Spark's JDBC source."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def union_parts(parts: Mapping[str, Callable[[], DataFrame]], tag: str,
                optional: Sequence[str] = ()) -> tuple[DataFrame | None, list[str]]:
    """S4 + X1: one frame per part (e.g. one relation per region), tagged with
    the part name, unioned by column name.  A part whose plan fails to resolve
    (missing relation / column) raises, unless it is named in ``optional``: it is
    skipped then.  Returns the union and the names of the skipped parts; empty
    parts simply contribute no rows."""
    frames, skipped = [], []
    for name, build in parts.items():
        try:
            df = build()
            df.schema  # resolve now so a missing relation is skipped here
        except AnalysisException:
            if name not in optional:
                raise
            skipped.append(name)
            continue
        frames.append(df.withColumn(tag, F.lit(name)))
    return (union_all(frames) if frames else None), skipped


def feature_collection_json(features: DataFrame, id_col: str, prop: str = "sigla") -> DataFrame:
    """Build a one-document GeoJSON-like FeatureCollection from a (bounded)
    feature table - used to produce a file in the shape the reader expects."""
    f = features.select(F.struct(F.lit("Feature").alias("type"),
                                 F.struct(F.col(id_col).alias(prop)).alias("properties")).alias("f"))
    return f.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                    F.collect_list("f").alias("features"))).alias("value"))


def write_feature_documents(features: DataFrame, path: str, id_col: str, prop: str = "id",
                            others: Sequence[str] = (), documents: int = 8) -> str:
    """Feature collections, one JSON document a file, each written line by line by one task; the
    features are dealt out to ``documents`` files by a hash of their id. ``others`` are
    further columns to write as properties."""
    part = F.pmod(F.xxhash64(id_col), F.lit(documents)).cast("int").alias("part")
    rows = features.select(part, F.lit(1).alias("kind"), F.col(id_col).alias("k"), F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col(id_col).alias(prop), *others).alias("properties"))).alias("value"))
    first = F.row_number().over(Window.partitionBy("part").orderBy("k")) == 1
    rows = rows.withColumn("value", F.when(first, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))))
    ends = features.sparkSession.range(documents).select(F.col("id").cast("int").alias("part"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit('{"type":"FeatureCollection","features":[').alias("value")),
        F.struct(F.lit(2).alias("kind"), F.lit("]}").alias("value")))).alias("e"))
    rows = rows.unionByName(ends.select("part", "e.kind", F.lit(None).cast(rows.schema["k"].dataType).alias("k"), "e.value"))
    rows.repartition(documents, "part").sortWithinPartitions("part", "kind", "k").select("part", "value") \
        .write.mode("overwrite").partitionBy("part").text(path)
    return path


def write_feature_lines(features: DataFrame, path: str, id_col: str, prop: str = "id") -> str:
    """One feature a line, written in parallel (for tables of places of any length)."""
    features.select(F.lit("Feature").alias("type"), F.struct(F.col(id_col).alias(prop)).alias("properties")) \
        .write.mode("overwrite").json(path)
    return path


def read_feature_lines(spark: SparkSession, path: str, prop: str = "id", kind: str = "long") -> DataFrame:
    """S8 for features as lines: one row per feature with its key property."""
    rows = spark.read.schema(f"type string, properties struct<{prop}: {kind}>").json(path)
    return rows.select(F.col(f"properties.{prop}").alias(prop))


def read_features(spark: SparkSession, path: str, prop: str = "sigla") -> DataFrame:
    """Feature-collection JSON -> one row per feature with its key property.

    The schema is given, so no inference pass reads the document first."""
    schema = (f"type string, features array<struct<type: string, properties: struct<{prop}: string>>>")
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode("features").alias("f")).select(F.col(f"f.properties.{prop}").alias(prop))
