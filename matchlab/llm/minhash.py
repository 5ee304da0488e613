"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct 3-word (or 5-word) shingles. One permutation
scatters the shingles over the 32-bit ring, a second one ranks the ring, and
coordinate k of the signature is the least rank after shifting the ring by k. So
two permutations give all coordinates. Bands of coordinates are the buckets. With
32 bands of 6 rows a pair at Jaccard 0.85 misses all buckets with probability
(1 - 0.85^6)^32 < 3e-7.

Documents of equal sets are one representative. Within a bucket no pairs are
listed at first: every representative is compared with the bucket's hub, the one
that meets most others in all its buckets. Links are confirmed on the full sets.
Components are then contracted. A hub has met its whole bucket and leaves it; a
bucket within one component is done. The rest goes on with its next hub. What is
still open after some rounds is compared exactly, block by block of what the open
buckets connect, and only links leave a task. A pair inside one component cannot
change the result.

Defined cases: null and empty texts have an empty set, are linked with nothing
and are their own component; equal texts are linked; different texts under one id
are linked by it; a row with a null id is kept, and not linked. Empty tables give empty
results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .ship import arrow_map, ship
from .store import written

BANDS, ROWS = 32, 6

U32 = np.uint32


def _rank(x: np.ndarray, out: np.ndarray, tmp: np.ndarray, shift: int) -> np.ndarray:
    """The second permutation (a bijection of 32-bit integers) of ``x`` shifted by ``shift``."""
    np.add(x, U32(shift), out=out)
    for by, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(out, U32(by), out=tmp)
        np.bitwise_xor(out, tmp, out=out)
        np.multiply(out, U32(factor), out=out)
    np.right_shift(out, U32(16), out=tmp)
    return np.bitwise_xor(out, tmp, out=out)


def signatures(shingles: np.ndarray, first: np.ndarray, coords: int) -> np.ndarray:
    """[sets, coords] of 32-bit minima; ``first`` are the offsets of sets that aren't empty."""
    sig = np.empty((len(first), coords), U32)
    if not len(first):
        return sig
    x = (vec.mix64(shingles ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(U32)
    out, tmp = np.empty_like(x), np.empty_like(x)
    for k in range(coords):
        sig[:, k] = np.minimum.reduceat(_rank(x, out, tmp, k), first)
    return sig


def shingle_sets(buf, offs, n: int):
    """(distinct shingle hashes, sorted within each document; offsets by document)."""
    h, woffs = vec.word_hashes(buf, offs, vec.NOT_SPACE)
    docs = len(woffs) - 1
    starts = vec.gram_starts(woffs, n)
    values, doc = [], []
    if len(starts):
        values.append(vec.grams(h, n)[starts])
        doc.append(np.searchsorted(woffs, starts, side="right") - 1)
    counts = np.diff(woffs)
    for m in range(1, n):  # fewer words: the whole sequence
        d = np.flatnonzero(counts == m)
        if len(d):
            values.append(vec.grams(h, m)[woffs[d]])
            doc.append(d)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    v, d = np.concatenate(values), np.concatenate(doc)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))
    return v[new], np.searchsorted(d[new], np.arange(docs + 1))


def digests(v: np.ndarray, so: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each set."""
    size = np.diff(so)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = vec.mix64(np.add.reduceat(vec.mix64(v ^ np.uint64(0x5851F42D4C957F2D)), so[full]) + size[full].astype(np.uint64))
    return out


#: Words of a chunk are far fewer than its bytes, and the arrays of a signature
#: pass fit the processor's cache.
CHUNK = 1 << 19


def _signer(n: int, bands: int, rows: int):
    def run(batches):
        from matchlab.llm import minhash as own
        from matchlab.llm import vec

        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("_text"))
            for i, j in vec.doc_chunks(offs, own.CHUNK):
                v, so = own.shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                size = np.diff(so)
                full = np.flatnonzero(size)
                sig = own.signatures(v, so[full], bands * rows)
                keys = np.zeros((len(full), bands), np.uint64)
                for b in range(bands):
                    k = np.full(len(full), b + 1, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        k = vec.mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
                    keys[:, b] = k
                s1 = own.digests(v, so)
                at = np.cumsum(np.append(0, np.where(size > 0, bands, 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), pa.array(size.astype(np.int64)),
                     pa.array(s1.view(np.int64)), vec.lists(at, pa.array(keys.ravel().view(np.int64)))],
                    names=["_id", "n", "s1", "keys"])
    return run


def _setter(n: int):
    def run(batches):
        from matchlab.llm import minhash as own
        from matchlab.llm import vec

        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("_text"))
            for i, j in vec.doc_chunks(offs):
                v, so = own.shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.digests(v, so).view(np.int64)), vec.lists(so, pa.array(v.view(np.int64)))], names=["v", "set"])
    return run


#: Ids that may be broadcast to pick documents; beyond it Spark joins by shuffle.
BROADCAST_IDS = 2_000_000


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    p = pairs.join(sets.select(F.col("v").alias("b"), F.col("set").alias("sb")), "b")
    p = p.join(sets.select(F.col("v").alias("a"), F.col("set").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    both = F.when(100 * F.least(na, nb) >= percent * F.greatest(na, nb), F.size(F.array_intersect("sa", "sb"))).otherwise(-1)
    p = p.select("a", "b", na.alias("na"), nb.alias("nb"), both.alias("both"))
    return p.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


#: Sets and shingles of a block; a task compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 400, 250_000
#: Shingles that one step of a block's product holds.
COLUMNS = 4096


def block_links(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Links (i, j) between sets of ``left`` and ``right`` that lie in different components, one
    for each pair of components. Intersections are counted exactly, as products of 0-1
    matrices over the shingles that two sets hold at least."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    row, col = row[shared[col]], number[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((int(left.sum()), int(right.sum())), np.float32)
    at = np.zeros((len(sets), COLUMNS), np.float32)
    for c in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        at[row[lo:hi], col[lo:hi] - c] = 1
        both += at[left] @ at[right].T
        at[row[lo:hi], col[lo:hi] - c] = 0
    l, r = np.flatnonzero(left), np.flatnonzero(right)
    both = both.astype(np.int64)
    good = 100 * both >= percent * (size[l][:, None] + size[r][None, :] - both)
    i, j = np.nonzero(good & (comp[l][:, None] != comp[r][None, :]))
    i, j = l[i], r[j]
    ends = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])], 1)
    _, first = np.unique(ends, axis=0, return_index=True)
    return i[first], j[first]


def _blocks(percent: int):
    def run(table):
        from matchlab.llm import minhash as own

        t = table.combine_chunks()
        col = t["set"].combine_chunks()
        offs, flat = np.asarray(col.offsets), col.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]
        v, block = t["v"].to_numpy(), t["block"].to_numpy()
        i, j = own.block_links(sets, t["comp"].to_numpy(), block == t["lo"].to_numpy(), block == t["hi"].to_numpy(), percent)
        return pa.table({"a": pa.array(v[i], pa.int64()), "b": pa.array(v[j], pa.int64())})
    return run


def _family_links(b: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among vertices that buckets tie together.

    ``b`` has the open buckets (key, v, comp, a: the next hub). A family is what its buckets
    connect; it is cut into blocks by a hash, as many as its sets ask for, and each task
    compares two blocks of a family and returns links only. So no pairs are listed and no
    family has to fit one task."""
    ship(b.sparkSession)
    tied = components(b.select(F.col("a").alias("u"), "v"))
    v = b.select("v", "comp").distinct().join(tied.withColumnRenamed("id", "v"), "v", "left") \
        .select("v", "comp", F.coalesce("component", "v").alias("family"))
    v = v.join(sets.select("v", F.size("set").alias("n")), "v")
    total = v.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    total = total.where("lo < hi").select("family", F.greatest(
        F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    v = v.join(total, "family").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    v = v.select("v", "comp", "family", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return v.join(sets, "v").groupBy("family", "lo", "hi").applyInArrow(_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS, hub_rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (least id
    reachable over links of Jaccard >= percent / 100, the own id included)."""
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    sig = written(arrow_map(d, _signer(shingle, bands, rows), f"_id {kind}, n long, s1 long, keys array<long>"),
                  "minhash-signatures")
    # a vertex is a set, known by its digest; equal sets are one vertex
    vertex = sig.where("n > 0 AND _id IS NOT NULL")
    reps = vertex.groupBy("s1").agg(F.min("_id").alias("rep"), F.min_by("keys", "_id").alias("keys"))
    reps = written(reps, "minhash-representatives")

    spread = reps.select("s1", F.explode("keys").alias("key"))
    wide = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = written(spread.join(wide, "key").select("key", F.col("s1").alias("v"), "c"), "minhash-buckets")
    weight = written(buckets.groupBy("v").agg(F.sum("c").alias("w")), "minhash-weights")

    chosen = reps.join(weight, reps["s1"] == weight["v"], "left_semi").select(F.col("rep").alias("_id")).distinct()
    chosen = F.broadcast(chosen) if weight.count() <= BROADCAST_IDS else chosen
    sets = arrow_map(d.join(chosen, "_id", "left_semi"), _setter(shingle), "v long, set array<long>")
    sets = written(sets.dropDuplicates(["v"]), "minhash-sets")

    # an id of several texts ties its sets together
    ties = vertex.groupBy("_id").agg(F.min("s1").alias("u"), F.max("s1").alias("o")).where("u <> o").select("_id", "u")
    new = written(vertex.join(ties, "_id").select("u", F.col("s1").alias("v")).where("u <> v").distinct(), "minhash-ties")
    comp = new.select(F.col("u").alias("id"), F.col("v").alias("component")).where("false")
    if new.head(1):
        comp = components(new)
    b = buckets.join(weight, "v").select("key", "v", "w")
    for turn in range(hub_rounds + 1):
        b = b.select("key", "v", "w").join(comp.withColumnRenamed("id", "v"), "v", "left") \
            .select("key", "v", "w", F.coalesce("component", "v").alias("comp"))
        span = b.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                    F.max(F.struct("w", "v", "comp")).alias("hub"))
        # what lies in one component is done
        span = span.where("lo < hi").select("key", F.col("hub.v").alias("a"), F.col("hub.comp").alias("ca"))
        b = written(b.join(span, "key"), "minhash-open")
        if turn < hub_rounds:
            pairs = written(b.where("ca <> comp").select("a", F.col("v").alias("b")).distinct(), "minhash-pairs")
            if not pairs.head(1):
                break
            new = _confirmed(pairs, sets, percent)
        else:
            new = _family_links(b, sets, percent)
        new = written(new, "minhash-links")
        if new.head(1):
            stars = comp.select(F.col("id").alias("u"), F.col("component").alias("v"))
            comp = components(stars.unionByName(new.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        b = b.where("v <> a")  # the hub has met all of its bucket

    least = reps.select("s1", "rep").join(comp.withColumnRenamed("id", "s1"), "s1", "left") \
        .select("s1", "rep", F.coalesce("component", "s1").alias("comp"))
    root = least.groupBy("comp").agg(F.min("rep").alias("root"))
    least = least.join(root, "comp").select("s1", "root")
    out = sig.select("_id", "n", "s1").join(least, "s1", "left")
    return out.select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("_id").isNotNull(), F.col("root")).otherwise(F.col("_id")).alias("component_id"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The documents (all their columns) without near-copies: of each component the one of
    the least id. Repeated rows of that id are one document; null ids stay."""
    keep = near_duplicates(docs, **kw).where("doc_id = component_id").select("doc_id").distinct()
    keep = written(keep, "minhash-kept")
    keep = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep
    out = docs.join(keep, "doc_id", "left_semi")
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id"), "minhash-twice")
    if twice.head(1):
        again = out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(twice, "doc_id", "left_anti").unionByName(again)
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
