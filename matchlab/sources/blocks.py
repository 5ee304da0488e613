"""Records that cross line and block borders, read in many tasks.

Spark's text scan cuts a file into byte ranges and hands out the pieces between
separators; each piece belongs to the range (block) in which it begins. Whether a
separator ends a record depends on all that stands before it in the file: on the parity
of the quotes in CSV, on string state and depth of braces in JSON. A block is summed up
in a row of counters; running totals of those rows, in the order of the file, give the
state at the beginning of every block, and a running total inside the block the state
at every piece. A record is a piece that begins at rest with those after it that don't;
its first piece names it, so the part in the next block finds it.

Only counters pass a window over a file, a row for each block. Of CSV only the records
that cross a border of blocks are shuffled, the others are joined where they are read; the text of
JSON is shuffled by block, then by record. Compressed files can't be cut and are one block each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog

_BLOCK = ["_file", "_block"]


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("_row")


def _in_file() -> WindowSpec:
    return Window.partitionBy("_file").orderBy("_block")


def _before(c, window: WindowSpec) -> Column:
    """Total of the rows before this one."""
    return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Pieces between separators. ``_row`` orders the pieces of one block, which one task reads
    from its first byte to its last; it doesn't order blocks."""
    return spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")


def _records(pieces: DataFrame, sep: str) -> DataFrame:
    """(text, first): pieces joined to records, which begin where ``_rest`` is true;
    ``first`` marks the record at the beginning of a file, which ``_first`` marks where it is given."""
    start = F.when(F.col("_rest"), F.col("_row"))
    p = pieces.withColumn("_own", F.last(start, ignorenulls=True).over(_in_block()))
    if "_first" not in pieces.columns:
        p = p.withColumn("_first", (F.col("_block") == 0) & (F.row_number().over(_in_block()) == 1))
    open_ = F.last("_last", ignorenulls=True).over(_in_file().rowsBetween(Window.unboundedPreceding, -1))
    blocks = pieces.groupBy(*_BLOCK).agg(F.max(start).alias("_last")).select(*_BLOCK, open_.alias("_open"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_row", "value")))
    return (p.join(blocks, _BLOCK).groupBy("_file", F.coalesce("_own", "_open").alias("_record"))
            .agg(F.array_join(F.transform(parts, lambda x: x["value"]), sep).alias("text"),
                 F.bool_or("_first").alias("first"))
            .select("text", "first"))


_JOINED = "_file string, _block long, _row long, value string, _rest boolean, _first boolean, _whole boolean"


def _joined(batches: Iterator[pa.RecordBatch], kinds: tuple[bool, ...] = (True, False)) -> Iterator[pa.RecordBatch]:
    """Pieces (_file, _block, _row, value, _quotes, and _carry, the quotes before the block) in their order,
    joined by line breaks as far as their block goes. ``_whole``: a record that begins and ends in it;
    else the end of an earlier one, or one that may go on behind it (at ``_rest``). ``kinds`` of
    ``_whole`` are returned."""
    block, carry, held = None, 0, []  # the open record: values, with its first row before them
    rest = first = False

    def row(whole):
        return [[block[0]], [block[1]], [held[0]], ["\n".join(held[1:])], [rest], [first], [whole]]

    def out(columns):
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
        names = ("_file", "_block", "_row", "value", "_rest", "_first", "_whole")
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    for batch in batches:
        files = pc.run_end_encode(batch["_file"])
        starts = np.concatenate([[0], np.asarray(files.run_ends)]) if len(batch) else np.zeros(1, int)
        at = batch["_block"].to_numpy()
        cuts = sorted({*starts.tolist(), *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()})
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            here = (part["_file"][0].as_py(), int(at[lo]))
            rows, quotes, values = part["_row"].to_numpy(), part["_quotes"].to_numpy(), part["value"]
            begins = here != block
            if begins:
                if held and False in kinds:
                    yield out(row(False))
                block, carry, held = here, part["_carry"][0].as_py(), []
            before = carry + np.cumsum(quotes) - quotes
            carry = int(before[-1] + quotes[-1])
            at_rest = np.flatnonzero(before % 2 == 0)
            stop = int(at_rest[0]) if len(at_rest) else len(part)
            if stop:  # goes on with the open record, or with one of an earlier block
                if not held:
                    held, rest, first = [int(rows[0])], False, here[1] == 0
                held += values[:stop].to_pylist()
            if not len(at_rest):
                continue
            if held and rest in kinds:
                yield out(row(rest))
            if len(at_rest) > 1 and True in kinds:
                a, b = stop, int(at_rest[-1])
                lists = pa.ListArray.from_arrays(pa.array(at_rest - a, pa.int32()), values[a:b])
                n = len(lists)
                yield out([pa.repeat(here[0], n), pa.repeat(here[1], n), rows[at_rest[:-1]], pc.binary_join(lists, "\n"),
                           pa.repeat(True, n), (at_rest[:-1] == 0) & (begins and here[1] == 0), pa.repeat(True, n)])
            last = int(at_rest[-1])
            held, rest, first = [int(rows[last]), *values[last:].to_pylist()], True, begins and here[1] == 0 and last == 0
    if held and False in kinds:
        yield out(row(False))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text, first): the records of CSV files whose quoted values may hold line breaks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    p = _pieces(spark, path, "\n").withColumn("_quotes", _count(F.col("value"), '"'))
    blocks = p.groupBy(*_BLOCK).agg(F.sum("_quotes").alias("_quotes")).select(
        *_BLOCK, _before("_quotes", _in_file()).alias("_carry"))
    # a row for each block of a file (128 MB): broadcast, which leaves the pieces in their order
    p = p.join(F.broadcast(blocks), _BLOCK).select(*_BLOCK, "_row", "value", "_quotes", "_carry")
    whole, crossing = (p.mapInArrow(partial(_joined, kinds=(k,)), _JOINED) for k in (True, False))
    whole = whole.select(F.col("value").alias("text"), F.col("_first").alias("first"))
    # written: two of a block at most, read twice
    crossing = catalog.written(crossing.drop("_whole"), "crossing")
    r = whole.unionByName(_records(crossing, "\n"))
    return r.withColumn("text", F.regexp_replace("text", r"\r$", ""))


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """S1 for CSV with line breaks in values: the rows of ``read_csv`` with ``multi_line``, but a
    file is read by as many tasks as it has blocks, and line breaks inside values stay as they are.

    Values that hold a quote must be quoted, with the quote doubled (as pandas and
    Spark's sink write them): the parity of the quotes decides what is a row. Empty
    lines between rows are no rows. A row that doesn't fit the schema fails the read."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = csv_records(spark, path).where(F.col("text") != "")
    if header:
        rows = rows.where(~F.col("first"))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    return rows.select(F.from_csv("text", F.lit(_ddl(schema)), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


#: A JSON string, or the rest of the text if it doesn't end; an escape; what stands before the
#: first brace that is in no string.
_STRING, _ESCAPE = r'"[^"]*+(?:"|$)', r"(?s)\\."
_TO_BRACE = r'^(?:[^"{]++|"(?:[^"\\]++|(?s:\\.))*+")*+(?=\{)'


def json_features(spark: SparkSession, path: str) -> DataFrame:
    """(text): the objects one level below the root of JSON documents, one document a file.

    Pieces end at closing braces, whether those are in strings or not. A piece counts its
    opening braces twice, for a beginning outside and inside of a string; the parity of
    the quotes before it, escaped ones apart, tells which count holds."""
    plain = F.regexp_replace("value", _ESCAPE, "")
    p = _pieces(spark, path, "}").withColumn("_plain", plain).withColumns({
        "_quotes": _count(F.col("_plain"), '"'),
        "_out": _count(F.regexp_replace("_plain", _STRING, ""), "{"),
        "_in": _count(F.regexp_replace(F.concat(F.lit('"'), F.col("_plain")), _STRING, ""), "{"),
    }).drop("_plain")
    p = p.withColumn("_inside", _before("_quotes", _in_block()) % 2)
    ends = (F.col("_inside") + F.col("_quotes")) % 2

    def depth(begin: int) -> Column:
        """Change of the depth by a piece, if its block begins outside (0) or inside (1) of a string."""
        return F.when(F.col("_inside") == begin, F.col("_out")).otherwise(F.col("_in")) - (ends == begin).cast("long")

    p = p.withColumns({"_d0": depth(0), "_d1": depth(1)})
    blocks = p.groupBy(*_BLOCK).agg(*[F.sum(c).alias(c) for c in ("_quotes", "_d0", "_d1")])
    blocks = blocks.select(*_BLOCK, "_d0", "_d1", (_before("_quotes", _in_file()) % 2).alias("_begin"))
    change = F.when(F.col("_begin") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    blocks = blocks.select(*_BLOCK, "_begin", _before(change, _in_file()).alias("_depth"))
    p = p.join(blocks, _BLOCK).withColumn("_change", change)
    outside = F.col("_begin") == F.col("_inside")
    r = _records(p.withColumn("_rest", outside & (F.col("_depth") + _before("_change", _in_block()) <= 1)), "}")
    below = F.when(F.col("first"), F.regexp_replace("text", r"^[^{]*+\{", "")).otherwise(F.col("text"))
    return r.select(F.concat(F.regexp_replace(below, _TO_BRACE, ""), F.lit("}")).alias("text")) \
        .where(F.col("text").startswith("{"))


def read_feature_blocks(spark: SparkSession, path: str, prop: str = "id", kind: str = "long") -> DataFrame:
    """S8 for feature collections of any size: what ``read_features`` returns, but a document is
    read by as many tasks as it has blocks. A feature is an object one level below the root with
    ``type`` "Feature"; one that is no JSON fails the read."""
    f = F.from_json("text", F.lit(f"type string, properties struct<`{prop}`: {kind}>"), {"mode": "FAILFAST"})
    return json_features(spark, path).select(f.alias("f")).where("f.type = 'Feature'") \
        .select(F.col("f.properties").getField(prop).alias(prop))
