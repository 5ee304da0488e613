"""Exact top-k inner products of integer vectors by MaxScore over sharded postings.

Every dimension is a term; a shard holds, for each term, the components of its vectors
(a posting list) and their greatest and least. A term's score for a query lies between two
bounds, and is counted from the lower one, so that it is never negative. Terms are ordered
by the width of their bounds. The non-essential ones are the narrowest whose widths
together stay below the query's threshold: no vector gets into the result by them alone.
The essential postings are traversed; the others are probed, widest first, for the vectors
whose score so far and the widths to come still reach the threshold. The threshold is the
k-th best score known: at first among the queries' own vectors, then in the shards that a
task has seen. What reaches it is exact. The k best of every shard are merged by a window.

Queries are taken in blocks of bounded size; a block is sent to the tasks, which read all
vectors in shards of bounded size. So every query meets every vector, no pairs are listed,
and what is held does not grow with the tables.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors of other lengths are filled up with zeros, so an empty one scores 0; ties go to the
smaller id, null ids last; a row is its own query's only forbidden candidate, rows
that repeat an id or a vector are candidates like others; a null id is never a query. Less
than k candidates give less than k rows, an empty table none. A component beyond the
64-bit range is taken as its limit, and sums beyond it wrap round like Spark's long.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ship import arrow_map, ship
from .store import new_path, written

#: Numbers of a shard and of a block of queries.
SHARD, BLOCK = 1 << 20, 1 << 21
#: Non-essential terms probed between two looks at what is still competitive.
PROBE = 6
NEVER = np.iinfo(np.int64).min


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(row, id, v): floor(scale * x) of the vectors that take part, written, so that a row
    keeps its number."""
    x = F.col(embedding).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = vectors.where(x.isNotNull() & whole)
    return written(d.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("id"),
                            F.transform(x, lambda c: F.floor(c * scale)).alias("v")), "search-vectors")


def matrix(col: pa.Array) -> np.ndarray:
    """[vectors, dimensions] of a list column, filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(pc.list_value_length(col).to_numpy(zero_copy_only=False), np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), int(size[0]))
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    first = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first, size)] = flat
    return out


class Shard:
    """Postings of some vectors: one row per term, and the bounds of its components."""

    def __init__(self, v: np.ndarray):
        self.exact = v
        self.n, self.terms = v.shape
        self.high = v.max(0) if self.n else np.zeros(self.terms, np.int64)
        self.low = v.min(0) if self.n else np.zeros(self.terms, np.int64)
        self.most = np.maximum(np.abs(self.high.astype(float)), np.abs(self.low.astype(float)))
        self.postings = {}

    def of(self, kind) -> np.ndarray:
        if kind not in self.postings:
            self.postings[kind] = np.ascontiguousarray(self.exact.T.astype(kind))
        return self.postings[kind]

    def search(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all vectors whose inner product with ``q`` is ``least`` or more."""
        t = min(len(q), self.terms)
        q = q[:t]
        size = float((np.abs(q.astype(float)) * self.most[:t]).sum())
        if size >= 2.0 ** 52:  # beyond exact floating sums: 64-bit integers, no bounds
            with np.errstate(over="ignore"):
                s = self.exact[:, :t] @ q
            at = np.flatnonzero(s >= least)
            return at, s[at]
        kind = np.float32 if size < 2.0 ** 23 else np.float64
        q = q.astype(kind)
        post = self.of(kind)
        a, b = q * self.low[:t].astype(kind), q * self.high[:t].astype(kind)
        low, width = np.minimum(a, b).astype(float), np.abs(a - b).astype(float)
        goal = float(least) - low.sum()  # of the scores counted from their lower bounds
        order = np.argsort(-width, kind="stable")
        rest = np.append(np.cumsum(width[order][::-1])[::-1], 0.0)  # widths from a term on
        e = int(np.argmax(rest < goal)) if (rest < goal).any() else t  # essential terms
        base = np.append(0.0, np.cumsum(low[order]))
        score = (q[order[:e]] @ post[order[:e]]).astype(float) if e else np.zeros(self.n)
        at = np.flatnonzero(score - base[e] + rest[e] >= goal)
        score = score[at]
        for k in range(e, t, PROBE):
            terms = order[k:k + PROBE]
            score = score + q[terms] @ post[np.ix_(terms, at)] if len(at) < self.n else score + q[terms] @ post[terms]
            j = k + len(terms)
            keep = score - base[j] + rest[j] >= goal
            at, score = at[keep], score[keep]
        return at, score.astype(np.int64)


def _searcher(block, k: int):
    def run(batches):
        from matchlab.llm import maxscore as own

        rows, ids, vectors, least = block.value
        least, best = least.copy(), np.full((len(rows), k), own.NEVER, np.int64)
        for shard_rows, shard_ids, shard in own.shards(batches):
            place = np.empty(len(shard_rows), np.int64)  # of a vector in the order of ids, null last
            place[np.asarray(pc.sort_indices(shard_ids, null_placement="at_end"))] = np.arange(len(shard_rows))
            q_at, v_at, found = [], [], []
            for i in range(len(rows)):
                at, score = shard.search(vectors[i], int(least[i]))
                other = shard_rows[at] != rows[i]
                at, score = at[other], score[other]
                if len(at) > k:
                    good = score >= np.partition(score, len(score) - k)[len(score) - k]
                    at, score = at[good], score[good]
                    good = np.lexsort((place[at], -score))[:k]
                    at, score = at[good], score[good]
                if len(at):
                    best[i] = np.sort(np.append(best[i], score))[-k:]
                    least[i] = max(least[i], best[i, 0])
                q_at.append(np.full(len(at), i))
                v_at.append(at)
                found.append(score)
            q_at, v_at = np.concatenate(q_at).astype(np.int64), np.concatenate(v_at).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[q_at]), ids.take(pa.array(q_at)), shard_ids.take(pa.array(v_at)),
                 pa.array(np.concatenate(found).astype(np.int64))], names=["row", "query_id", "vec_id", "score"])
    return run


def shards(batches):
    """(rows, ids, Shard) of at most SHARD numbers, from Arrow batches (row, id, v)."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            piece = batch.slice(lo, 1024)
            n = len(piece.column("v").flatten()) + piece.num_rows
            if held and size + n > SHARD:
                yield _shard(held)
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield _shard(held)


def _shard(held):
    t = pa.Table.from_batches(held).combine_chunks()
    return t["row"].to_numpy(), t["id"].combine_chunks(), Shard(matrix(t["v"]))


def _search(block, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of every shard for every query of the block, as far as they can matter."""
    kind = vectors.schema["id"].dataType.simpleString()
    return arrow_map(vectors, _searcher(block, k), f"row long, query_id {kind}, vec_id {kind}, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256,
          vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every row that the
    condition ``queries`` on ``id`` picks, among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    v = integers(vectors, vec_id, embedding, scale)
    q = v.where(queries)
    count, numbers = q.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    kind = v.schema["id"].dataType.simpleString()
    blocks = -(-int(numbers) // BLOCK)
    path = new_path(spark, "search-found")
    for b in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        t = own.toArrow().combine_chunks()
        if not t.num_rows:
            continue
        rows, ids, m = t["row"].to_numpy(), t["id"].combine_chunks(), matrix(t["v"])
        least = np.full(len(rows), NEVER, np.int64)
        first = spark.sparkContext.broadcast((rows, ids, m, least))
        seen = _merged(_search(first, own, k), k).groupBy("row").agg(F.min("score").alias("s"), F.count("*").alias("c")) \
            .where(F.col("c") == k).toArrow()
        first.unpersist()
        place = {r: i for i, r in enumerate(rows.tolist())}
        for r, s in zip(seen["row"].to_pylist(), seen["s"].to_pylist()):
            least[place[r]] = s
        block = spark.sparkContext.broadcast((rows, ids, m, least))
        _merged(_search(block, v, k), k).write.mode("append").parquet(path)
        block.unpersist()
    shape = f"query_id {kind}, rank int, vec_id {kind}, score long"
    if not count:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path)
