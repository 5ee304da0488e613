"""Maximal runs (periodic stretches of words) by online dyadic square catching.

Every completed block of B = 1, 2, 4, ... words at a multiple of B is a catcher. It waits
for the squares of periods p in [2B - 1, 4B - 2] whose first half holds the block: such
a square holds the block's words again p later. Each of the 2B suffixes of B words
appended in that reach is compared with the block, by a rolling hash that doubles with B.
The catchers of one period that follow one another have met the squares of one run;
their ends are moved word by word as far as words p apart agree. Comparisons are made for
all catchers of a level at once, as arrays; a document of n words costs O(n log n).

A square's period is a multiple of the run's smallest period where the run was already
caught on a lower level; those go. What is left has its smallest period.

Words are compared by 64-bit hashes. Documents are cut from one another by values that no
word has, so no square crosses them; a document longer than a chunk is taken alone, and a
level's comparisons are made in slices of bounded size.

Defined cases: null and empty texts have no words and no runs, their collapsed text is
empty; equal rows are each given; null ids are kept. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .ship import arrow_map

U64 = np.uint64
#: Comparisons of catchers with suffixes that are held at once.
CELLS = 1 << 22


def _unlike(n: int, salt: int) -> np.ndarray:
    """``n`` values that no word and no other salt gives."""
    return vec.mix64(np.arange(1, n + 1, dtype=U64) * U64(0xA0761D6478BD642F) ^ U64(salt))


def _caught(h: np.ndarray, size: int, chain: int):
    """(first block of ``chain`` consecutive catchers that meet their words again, period)."""
    blocks = len(h) // size
    h = np.concatenate([h, _unlike(5 * size, 0x1F3D + size)])
    windows = np.lib.stride_tricks.sliding_window_view(h, 2 * size)[2 * size - 1::size]
    blocks = min(blocks, len(windows))
    step = max(1, CELLS // (2 * size))
    out_c, out_p = [], []
    for lo in range(0, blocks - chain + 1, step):
        hi = min(lo + step + chain - 1, blocks)
        met = windows[lo:hi] == h[lo * size:(hi - 1) * size + 1:size, None]
        whole = met[:len(met) - chain + 1]
        for k in range(1, chain):
            whole = whole & met[k:len(met) - chain + 1 + k]
        c, o = np.nonzero(whole)
        out_c.append(c + lo)
        out_p.append(o + 2 * size - 1)
    if not out_c:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_c), np.concatenate(out_p)


def _moved(w: np.ndarray, at: np.ndarray, p: np.ndarray, by: int) -> np.ndarray:
    """``at`` moved (by -1: to the left, by 1: to the right) while the words there agree with
    those p later; ``w`` ends in unlike values on both sides."""
    at = at.copy()
    go = np.arange(len(at))
    while len(go):
        a = at[go] - (by < 0)
        go = go[w[a] == w[a + p[go]]]
        at[go] += by
    return at


def _multiples(found: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether [lo, hi) lies in a known run whose period divides p. Of the runs that begin at
    lo or before, the one that ends last is asked; others are sorted out by their stretch."""
    if not len(found) or not len(lo):
        return np.zeros(len(lo), bool)
    r = found[np.argsort(found[:, 0], kind="stable")]
    top = np.maximum.accumulate(r[:, 1])
    at = np.maximum.accumulate(np.where(r[:, 1] == top, np.arange(len(r)), 0))
    k = np.searchsorted(r[:, 0], lo, side="right") - 1
    own = r[at[np.maximum(k, 0)]]
    return (k >= 0) & (own[:, 1] >= hi) & (p % own[:, 2] == 0)


def find_runs(w: np.ndarray, longest: int, exponent: int = 4, least: int = 6):
    """(start, end, period) of the maximal stretches of ``w`` with smallest period q and a
    length of at least max(least, exponent * q), ordered by start, end. ``longest`` bounds
    their length; exponent >= 2. Values that no others equal cut the array."""
    n = len(w)
    w = np.concatenate([_unlike(1, 0x51), w, _unlike(1, 0x52)])  # places move by one
    found = np.zeros((0, 3), np.int64)
    h, size = w[1:-1], 1
    while max(least, exponent * (2 * size - 1)) <= longest and len(h):
        p = np.arange(2 * size - 1, 4 * size - 1)
        again = np.maximum(least, exponent * p) - p  # words that agree with those p later
        chain = max(1, int(((again - size + 1) // size).min()))  # whole blocks of them
        c, per = _caught(h, size, chain)
        if len(c):
            order = np.lexsort((c, per))
            c, per = c[order], per[order]
            new = np.append(True, (per[1:] != per[:-1]) | (c[1:] != c[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(c)) - 1
            lo, hi, per = c[first] * size + 1, (c[last] + chain) * size + 1, per[first]
            keep = ~_multiples(found, lo, hi + per, per)
            lo, hi, per = lo[keep], hi[keep], per[keep]
            lo, hi = _moved(w, lo, per, -1), _moved(w, hi, per, 1)
            good = hi + per - lo >= np.maximum(least, exponent * per)
            found = np.concatenate([found, np.stack([lo, hi + per, per], 1)[good]])
        if len(h) <= size:
            break
        h = vec.mix64(h[:-size] * U64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # equal stretches: the smallest period
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))]
    found[:, :2] -= 1
    return found


def _catcher(exponent: int, least: int):
    def run(batches):
        from matchlab.llm import runs as own
        from matchlab.llm import vec

        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("_text"))
            for i, j in vec.doc_chunks(offs):
                yield own.chunk_runs(batch.column("_id").slice(i, j - i), buf[offs[i]:offs[j]],
                                     offs[i:j + 1] - offs[i], exponent, least)
    return run


def chunk_runs(ids: pa.Array, buf: np.ndarray, offs: np.ndarray, exponent: int, least: int) -> pa.RecordBatch:
    """The runs and the collapsed text of every document of a chunk."""
    starts, ends, woffs = vec.word_spans(buf, offs, vec.NOT_SPACE)
    docs, count = len(woffs) - 1, np.diff(woffs)
    doc = np.repeat(np.arange(docs), count)
    place = np.arange(len(starts)) + doc  # a cut behind each document
    w = np.empty(len(starts) + docs, U64)
    w[place] = vec.span_hashes(buf, starts, ends)
    cuts = woffs[1:] + np.arange(docs)
    w[cuts] = _unlike(docs, 0x77)
    found = find_runs(w, int(count.max()) if docs else 0, exponent, least)
    s, e, q = found.T
    of = np.searchsorted(cuts, s)
    order = np.lexsort((q, s, of))
    s, e, q, of = s[order], e[order], q[order], of[order]
    begin = woffs[:-1] + np.arange(docs)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s - begin[of], e - s, q)], ["start", "length", "period"])

    gone = np.zeros(len(w) + 1, np.int32)
    np.add.at(gone, s + q, 1)
    np.add.at(gone, e, -1)
    kept = np.cumsum(gone[:-1])[place] == 0
    # bytes of the kept words, each but a document's first with the byte before it, made a space
    a, b, d = starts[kept], ends[kept], doc[kept]
    joint = np.append(False, d[1:] == d[:-1]) if len(d) else np.zeros(0, bool)
    text = buf.copy()
    text[a[joint] - 1] = 32
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[a - joint] += 1
    edge[b] -= 1
    text = text[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    size = np.bincount(d, weights=b - a + joint, minlength=docs).astype(np.int64)
    at = np.append(0, np.cumsum(size))
    texts = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(at), pa.py_buffer(text)).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, vec.lists(np.searchsorted(of, np.arange(docs + 1)), runs), texts],
                                      names=["_id", "runs", "collapsed"])


def word_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period) and
    ``collapsed``, the words that no run holds after its first period, joined by one space."""
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    out = arrow_map(d, _catcher(exponent, least),
                    f"_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("_id", "doc_id")
