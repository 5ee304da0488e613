"""Token counts of flat token files by a separator scan.

A flat file holds the token identifiers of many documents, little-endian and of one
width, each document ended by the end-of-document identifier, without any index. The
files are cut into blocks; a task reads a block's bytes and finds the separators by
one vectorised comparison. A document may begin some blocks before its separator,
so a prefix scan over the blocks of a file carries the last separator and the
number of documents so far. The scan has two levels (blocks within a group, then
groups), so one huge file is spread too. What a block hands on is its separators.

The files are read in ranges through pyarrow's file systems (local and mounted
folders, S3, GCS, HDFS); where pyarrow doesn't know the scheme, Spark reads whole
files and the blocks are cut from them.

``write_flat`` tokenizes each text with byte-level BPE ranks in the task that read it and
stores each document's bytes as a line whose line separator is the separator's
bytes, so Spark's own text writer, with its commit, makes the flat files.

``document_token_counts`` keeps the streams of its tasks in a table instead, one row per
block of a fixed number of bytes wherever documents begin and end, and beside them the
ids in the order in which their documents went into the stream. Tokens and ids come from
one evaluation of the input: however its rows are shuffled, or dealt anew after a lost
executor, a count can't meet another document's id.

Defined cases: a null or empty text is a document of no tokens; tokens after the
last separator of a file are a document that isn't ended; empty files and empty
tables have no documents; a length that isn't a whole number of tokens fails.
"""

from __future__ import annotations

import base64
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ship import arrow_map
from .store import written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
WIDTH = 2
BLOCK = 1 << 20
#: Blocks of a group of the prefix scan.
GROUP = 4096


def _encoder(ranks: dict):
    """The function from an Arrow column of texts to the bytes of each one's tokens."""
    import tiktoken

    e = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
    return lambda col: [e.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes() if t else b"" for t in col.to_pylist()]


def _tokenizer(ranks: dict):
    def run(batches):
        from matchlab.llm import tokens as own

        encode = own._encoder(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode(batch.column("_text")), pa.binary())], names=["tokens"])
    return run


def _streamer(ranks: dict, block_bytes: int):
    """Blocks of one stream of tokens per task (file, block, at, size, content), each with the ids
    whose documents went into the stream since the block before, the first of them number ``first``."""
    def run(batches):
        from pyspark import TaskContext

        from matchlab.llm import tokens as own

        encode, end = own._encoder(ranks), own.EOD.to_bytes(own.WIDTH, "little")
        file, block, first, held, ids = TaskContext.get().partitionId(), 0, 0, b"", []

        def row(content):
            there = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([block * block_bytes], pa.int64()),
                 pa.array([len(content)], pa.int64()), pa.array([first], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), there), pa.array([content], pa.binary())],
                names=["file", "block", "at", "size", "first", "ids", "content"]), len(there)

        for batch in batches:
            ids.append(batch.column("_id"))
            held += b"".join(t + end for t in encode(batch.column("_text")))
            for k in range(0, len(held) // block_bytes * block_bytes, block_bytes):
                out, n = row(held[k:k + block_bytes])
                yield out
                block, first, ids = block + 1, first + n, [batch.column("_id").slice(0, 0)]
            held = held[len(held) // block_bytes * block_bytes:]
        if held:
            yield row(held)[0]
    return run


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})


def write_flat(docs: DataFrame, path: str, text: str = "text", ranks: str = RANKS) -> None:
    """Flat token files of all texts, one file per partition, in the rows' order."""
    shared = _ranks(docs.sparkSession, ranks)
    rows = arrow_map(docs.select(F.col(text).alias("_text")), _tokenizer(shared), "tokens binary")
    mark = EOD.to_bytes(WIDTH, "little").decode("latin-1")
    rows.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", mark) \
        .option("encoding", "ISO-8859-1").text(path)


def _separators(eod: int, width: int):
    def run(batches):
        from matchlab.llm import tokens as own

        for batch in batches:
            for k in range(batch.num_rows):
                path, at, size, group, block = (batch.column(c)[k].as_py() for c in ("path", "at", "size", "grp", "block"))
                data = batch.column("content")[k].as_py() if "content" in batch.schema.names else None
                if data is None:
                    data = own.read_range(path, at, size)
                hit = np.flatnonzero(np.frombuffer(data, f"<u{width}") == eod) + at // width
                yield pa.RecordBatch.from_pydict({
                    "path": [path], "grp": [group], "block": [block], "seps": pa.array([hit.tolist()], pa.list_(pa.int64()))})
    return run


def read_range(path: str, at: int, size: int) -> bytes:
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    else:
        system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        f.seek(at)
        return f.read(size)


def blocks(spark: SparkSession, path: str, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """(path, length, block, grp, at, size) of every block of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    step = block_bytes // width * width
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of tokens: "), F.col("path"))).cast("long"))
    b = files.withColumn("length", whole).select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    at = F.col("block") * step
    return b.select("path", "length", "block", F.floor(F.col("block") / GROUP).alias("grp"), at.alias("at"),
                    F.least(F.lit(step), F.col("length") - at).alias("size"))


def _known(path: str) -> bool:
    return path.split(":")[0] in ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss") or ":" not in path


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: path, doc_no (within the file), start and n_tokens (without the
    separator), ended."""
    b = blocks(spark, path, width, block_bytes)
    read = b.repartition("path", "block")
    if not _known(path):
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_p"), F.col("content").alias("_c"))
        cut = F.expr("substring(_c, CAST(at AS INT) + 1, CAST(size AS INT))")
        read = b.join(files, b["path"] == F.col("_p")).select(*b.columns, cut.alias("content"))
    ended, groups = _documents(read.drop("length"), eod, width)
    whole = groups.groupBy("path").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    rest = b.where("block = 0").select("path", "length").join(whole, "path")
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    rest = rest.select("path", F.col("n").alias("doc_no"), start.alias("start"),
                       (F.floor(F.col("length") / width) - start).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def _documents(read: DataFrame, eod: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The ended documents of the blocks ``read`` (path, grp, block, at, size and, unless it is to be
    read from the path, content), and the last separator and their number of each group of blocks."""
    found = arrow_map(read, _separators(eod, width), "path string, grp long, block long, seps array<long>")
    # per block: where its last separator is, and how many there are
    last = F.element_at("seps", -1)
    found = found.withColumn("last", F.when(F.size("seps") > 0, last)).withColumn("n", F.size("seps").cast("long"))
    before = Window.partitionBy("path", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = found.select("path", "grp", "block", "seps", "n", F.max("last").over(before).alias("last_in"), F.sum("n").over(before).alias("n_in"))
    groups = found.groupBy("path", "grp").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    over = Window.partitionBy("path").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    carry = groups.select("path", "grp", F.max("last").over(over).alias("last_out"), F.sum("n").over(over).alias("n_out"))
    s = inner.where("n > 0").join(carry, ["path", "grp"])
    s = s.select("path", "seps", F.coalesce("last_in", "last_out", F.lit(-1)).alias("open"),
                 (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))).alias("done"))
    starts = F.concat(F.array(F.col("open") + 1), F.transform("seps", lambda x: x + 1))
    ended = s.select("path", "done", F.posexplode(F.arrays_zip(F.col("seps").alias("sep"), F.slice(starts, F.lit(1), F.size("seps")).alias("start")))) \
        .select("path", (F.col("done") + F.col("pos")).alias("doc_no"), F.col("col.start").alias("start"),
                (F.col("col.sep") - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    return ended, groups


def document_token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK,
                          ranks: str = RANKS) -> DataFrame:
    """Writes the streams of tokens of ``docs`` below the shared folder and counts them: doc_id,
    n_tokens, file (the stream's number), doc_no, start."""
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    t = written(arrow_map(d, _streamer(_ranks(docs.sparkSession, ranks), block_bytes // WIDTH * WIDTH),
                          f"file int, block long, at long, size long, first long, ids array<{kind}>, content binary"), "flat-tokens")
    read = t.select(F.col("file").cast("string").alias("path"), F.floor(F.col("block") / GROUP).alias("grp"), "block", "at", "size", "content")
    counts, _ = _documents(read, EOD, WIDTH)
    ids = t.select("file", "first", F.posexplode("ids").alias("pos", "doc_id")) \
        .select("file", (F.col("first") + F.col("pos")).alias("doc_no"), "doc_id", F.lit(True).alias("there"))
    out = counts.withColumn("file", F.col("path").cast("int")).join(ids, ["file", "doc_no"], "full")
    both = F.col("there") & F.col("ended")
    n = F.when(both, F.col("n_tokens")).otherwise(F.raise_error(F.lit("documents and separators differ")).cast("long"))
    return out.select("doc_id", n.alias("n_tokens"), "file", "doc_no", "start")
