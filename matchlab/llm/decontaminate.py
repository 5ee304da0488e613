"""Benchmark decontamination by winnowing.

Words are hashed, and k-grams of k = 5 words give the candidate fingerprints. Of
every window of 6 consecutive k-gram hashes (10 words) the least is kept, the
rightmost one of equals. Any span of 10 words that a document shares with an item
therefore has a kept hash on both sides. Kept hashes of the documents that meet
one of the benchmark are extended to the windows of 10 words that hold them, and
each of those counts if its own hash is that of a window of an item. Items of
fewer than 10 words are one window each; all word sequences of their lengths are
looked up, since winnowing promises nothing below 10 words.

The benchmark side goes to the workers in blocks of whole items, each of about
``block_words`` words, so what is broadcast is bounded at any benchmark size. One
block is one pass over the documents. With more than one, documents get a row id
in a written table, and the hits of the passes are joined on it.

Defined cases: null and empty texts have no words, no hit and no items; a null
item text gives no window; repeated documents each get their row; repeated items
are items of their own and equal item ids count once. Items without an id count as one
item, the null at the end of items. Empty tables give empty
or clean results. Extra columns are ignored here, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .ship import arrow_map
from .store import written

WINDOW, K = 10, 5

HITS = "n_words long, runs array<struct<s:int,e:int>>, items array<string>"


def winnow(kg: np.ndarray, woffs: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the kept k-grams of documents that have at least ``window`` words."""
    span = window - k + 1
    starts = vec.gram_starts(woffs, window)
    if not len(starts):
        return starts
    view = np.lib.stride_tricks.sliding_window_view(kg, span)[starts]
    last = span - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(starts + last)


class Benchmark:
    """Sorted fingerprints, windows and the items of each window of one block."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int, k: int):
        self.window, self.k = window, k
        self.names = sorted(set(ids) - {None}) + [None] * (None in ids)
        place = {x: i for i, x in enumerate(self.names)}
        buf, offs = vec.text_buffer(texts)
        h, woffs = vec.word_hashes(buf[offs[0]:offs[-1]], offs - offs[0], vec.ALNUM)
        item = np.array([place[x] for x in ids], np.int64)
        counts = np.diff(woffs)
        kg = vec.grams(h, k)
        self.prints = np.unique(kg[winnow(kg, woffs, window, k)])
        self.by_length = {}
        for n in {window, *(int(c) for c in np.unique(counts) if 0 < c < window)}:
            whole = counts >= window if n == window else counts == n
            # windows of the chosen items only
            starts = vec.gram_starts(woffs, n)
            doc = np.searchsorted(woffs, starts, side="right") - 1
            starts, doc = starts[whole[doc]], doc[whole[doc]]
            if not len(starts):
                continue
            pair = np.unique(np.stack([vec.grams(h, n)[starts], item[doc].astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pair[:, 0], return_index=True)
            self.by_length[n] = keys, np.append(first, len(pair)), pair[:, 1].astype(np.int64)

    def hits(self, h: np.ndarray, woffs: np.ndarray):
        """(start, length, place of the window) of every window that occurs in the documents."""
        out = []
        for n, (keys, _, _) in self.by_length.items():
            if n == self.window:
                kg = vec.grams(h, self.k)
                kept = winnow(kg, woffs, self.window, self.k)
                kept = kept[vec.found(self.prints, kg[kept]) >= 0]
                reach = np.arange(-(self.window - self.k), 1)
                starts = np.unique((kept[:, None] + reach).ravel())
                starts = starts[starts >= 0]
                doc = np.searchsorted(woffs, starts, side="right") - 1
                starts = starts[starts + n <= woffs[doc + 1]]
                wide = _grams_at(h, starts, n)
            else:
                starts = vec.gram_starts(woffs, n)
                wide = vec.grams(h, n)[starts] if len(starts) else np.zeros(0, np.uint64)
            at = vec.found(keys, wide)
            ok = at >= 0
            out.append((starts[ok], np.full(int(ok.sum()), n), at[ok]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def _grams_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``vec.grams`` at some positions only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = h[starts].copy()
    for j in range(1, n):
        out *= np.uint64(vec._BASE)
        out += h[starts + j]
    return vec.mix64(out + np.uint64(n))


def _mark(h, woffs, bench: Benchmark):
    """By document: number of words, runs [s, e) of hit words, items (places in bench.names)."""
    n = len(woffs) - 1
    starts, lens, at = bench.hits(h, woffs)
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + lens, -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = hit.copy()
    edge[1:] &= ~hit[:-1]
    inner = woffs[:-1][woffs[:-1] < len(h)]
    edge[inner] = hit[inner]
    rs = np.flatnonzero(edge)
    stop = hit.copy()
    stop[:-1] &= ~hit[1:]
    tail = woffs[1:][woffs[1:] > 0] - 1
    stop[tail] = hit[tail]
    re = np.flatnonzero(stop) + 1
    rdoc = np.searchsorted(woffs, rs, side="right") - 1
    runs = (np.searchsorted(rdoc, np.arange(n + 1)), rs - woffs[rdoc], re - woffs[rdoc])
    pairs = []
    for length, (_, first, items) in bench.by_length.items():
        mine = lens == length
        a = at[mine]
        count = first[a + 1] - first[a]
        doc = np.repeat(np.searchsorted(woffs, starts[mine], side="right") - 1, count)
        base = np.cumsum(count) - count
        pairs.append(np.stack([doc, items[np.arange(int(count.sum())) - np.repeat(base - first[a], count)]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.diff(woffs), runs, (np.searchsorted(pairs[:, 0], np.arange(n + 1)), pairs[:, 1])


def _marker(bench, keys: list[str], inside=None):
    def run(batches):
        from matchlab.llm import decontaminate as own

        b = bench.value
        names = pa.array(b.names, pa.string())
        for batch in batches:
            text = batch.column("_id").field(inside) if inside is not None else batch.column("_text")
            buf, offs = vec.text_buffer(text)
            for i, j in vec.doc_chunks(offs):
                o = offs[i:j + 1] - offs[i]
                h, woffs = vec.word_hashes(buf[offs[i]:offs[j]], o, vec.ALNUM)
                n, (ro, rs, re), (io, items) = own._mark(h, woffs, b)
                runs = pa.StructArray.from_arrays([pa.array(rs.astype(np.int32)), pa.array(re.astype(np.int32))], ["s", "e"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in keys]
                    + [pa.array(n.astype(np.int64)), vec.lists(ro, runs), vec.lists(io, names.take(pa.array(items)))],
                    names=[*keys, "n_words", "runs", "items"])
    return run


def mark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = 2_000_000, inside: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (hit words as [s, e)), items (ids of
    items with a window in the document, as sorted strings, null last). With ``inside``, ``doc_id`` names
    a struct that is handed through, whose field of that place is the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")) \
        .where("text IS NOT NULL")
    # bytes / 2 bounds the words of a text
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    d = docs.select(F.col(doc_id).alias("_id"), *([F.col(text).alias("_text")] if inside is None else []))
    sent = ["_text"] if inside is None else []
    keys = ["_id"]
    if blocks > 1:
        d = written(d.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-docs")
        keys = ["_row", "_id"]
    schema = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in keys) + ", " + HITS
    passes = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64(F.coalesce("text", "id")), F.lit(blocks)) == b).toArrow()
        bench = spark.sparkContext.broadcast(Benchmark(part["id"].to_pylist(), part["text"], window, k))
        passes.append(arrow_map(d.select(*keys, *sent), _marker(bench, keys, inside), schema))
    if blocks == 1:
        return passes[0].withColumnRenamed("_id", "doc_id")
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    found = written(found, "decontaminate-hits")
    base = found.groupBy("_row").agg(F.first("_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    before = Window.partitionBy("_row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.select("_row", F.inline("runs")).withColumn("p", F.coalesce(F.max("e").over(before), F.lit(0)))
    runs = runs.select("_row", F.greatest("s", "p").alias("s"), "e").where("e > s")
    runs = runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    names = found.select("_row", F.explode("items").alias("i")).groupBy("_row") \
        .agg(F.array_sort(F.collect_set("i")).alias("items"), F.bool_or(F.col("i").isNull()).alias("unnamed"))
    names = names.select("_row", F.when(F.col("unnamed"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.col("items")).alias("items"))
    out = base.join(runs, "_row", "left").join(names, "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("runs", F.array().cast("array<struct<s:int,e:int>>")).alias("runs"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def n_hit(runs="runs"):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents (all their columns) without a hit. Marks and filters in one pass: the
    id column handed through is the whole row."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    out = mark(whole, benchmark, doc_id="_doc", inside=docs.columns.index("text"), **kw).where(F.size("runs") == 0)
    return out.select("doc_id.*")
