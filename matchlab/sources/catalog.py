"""Table management (S7, S9, S10): materialised derived tables.

The derived fact table is computed once and written as Parquet into the
shared folder named by ``spark.checkpoint.dir`` (never a machine-local temp
folder on a cluster), partitioned by region so region filters prune files.
Later queries in the same application read that table; lineage is cut, so a
lost executor only re-reads files instead of re-running the joins.

A table belongs to the state of its inputs when it was built. Reading it again
starts no job and lists no input; ``refresh`` compares the states on request and
forgets what is out of date.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: (application, name, key) -> (path, what reads it, inputs, their state)
_TABLES: dict[tuple, tuple] = {}


def _exists(path: str) -> bool:
    if "://" in path and not path.startswith("file:"):
        return True  # remote shared storage: trust the registry
    return os.path.exists(path.replace("file://", "").replace("file:", ""))


def write_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (),
                max_records_per_file: int | None = None, cluster_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` under the shared checkpoint folder and return the path.

    ``cluster_by`` sorts rows inside each write task (no shuffle), so the
    Parquet row-group min/max statistics let filters on those columns skip
    row groups."""
    spark = df.sparkSession
    if cluster_by:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    base = checkpoint_dir(spark)
    path = os.path.join(base, "matchlab-tables", f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, read again with its schema: fixed rows, cut lineage."""
    path = write_table(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_state(spark: SparkSession, paths) -> tuple:
    """Digest of the files under ``paths`` (their number, and names, sizes and times hashed), formed
    by the executors that list them; one row reaches the driver."""
    if not paths:
        return ()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    h = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first())


def _kept(spark: SparkSession, name: str, key: str, inputs: tuple[str, ...], make):
    """What ``make`` (path and reader of a new table) made for (application, name, key), once."""
    k = (spark.sparkContext.applicationId, name, key)
    path, reader, *_ = _TABLES.get(k, (None, None))
    if path is None or not _exists(path):
        state = input_state(spark, inputs)  # before the build: what comes later is a change
        path, reader = make(f"{name}-{hashlib.sha1(key.encode()).hexdigest()[:8]}")
        _TABLES[k] = path, reader, inputs, state
    return reader


def materialized(spark: SparkSession, name: str, key: str, build, partition_by: tuple[str, ...] = (),
                 cluster_by: tuple[str, ...] = (), inputs: tuple[str, ...] = ()) -> DataFrame:
    """Build-once table per (application, name, key); later calls read its files without
    a job, with the schema they were written with (a text partition '01' stays text).
    Changed ``inputs`` are seen after ``refresh``."""
    def make(title: str):
        built = build()
        path = write_table(built, title, partition_by, cluster_by=cluster_by)
        return path, spark.read.schema(built.schema).parquet(path)
    return _kept(spark, name, key, inputs, make)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[str, DataFrame]:
    """(path, reader): a table in ``buckets`` files by the hash of ``key``, each sorted by it, so a grouping,
    window or join by the key, with a table of as many buckets, needs no exchange."""
    spark = df.sparkSession
    title = f"matchlab_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = os.path.join(checkpoint_dir(spark), "matchlab-tables", title)
    # dealt out as the buckets are: a task writes one of them
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(title)
    return path, spark.table(title)


#: A key is hot that holds more than this part of the rows of a mean bucket.
HOT_PART = 0.25


@dataclass(frozen=True)
class CoLocated:
    """A table in two parts of disjoint keys: ``even`` is bucketed by the key, ``hot`` has the rows of the
    keys too long for a bucket (those without a key, too, if they are many), in no order."""

    key: str
    buckets: int
    even: DataFrame
    hot: DataFrame

    def per_key(self, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``operator``, which treats every key by itself, makes of the whole table: without an
        exchange on the even part, and on the hot one with Spark's own means against skew."""
        return operator(self.even).unionByName(operator(self.hot))


def co_located(spark: SparkSession, name: str, table_key: str, build, key: str, buckets: int | None = None,
               inputs: tuple[str, ...] = ()) -> CoLocated:
    """Build-once co-located table; ``buckets`` defaults to the session's shuffle partitions, so that other
    sides come dealt out alike. Hot keys are fewer than buckets / ``HOT_PART``, as each holds more than
    that part of a mean bucket: their list is broadcast."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make(title: str):
        df = build()
        total = df.agg(F.count(F.lit(1))).scalar()
        hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * n > total * HOT_PART)
        hot = F.broadcast(written(hot.select(F.col(key).alias("_hot")), f"{title}-keys"))
        is_hot = df[key].eqNullSafe(hot["_hot"])
        path, even = write_bucketed(df.join(hot, is_hot, "left_anti"), title, key, n)
        return path, CoLocated(key, n, even, written(df.join(hot, is_hot, "left_semi"), f"{title}-hot"))
    return _kept(spark, name, table_key, inputs, make)


def refresh(spark: SparkSession, name: str | None = None) -> list[str]:
    """Forget the tables (of one name, or all) whose inputs changed; their next reader builds them
    again. Returns their keys. Frames made before go on reading the old files."""
    app = spark.sparkContext.applicationId
    old = [k for k, (_, _, inputs, state) in _TABLES.items()
           if k[0] == app and name in (None, k[1]) and input_state(spark, inputs) != state]
    for k in old:
        del _TABLES[k]
    return [k[2] for k in old]
