"""Vectorised text helpers for Arrow batches: bytes in, numpy arrays out.

A batch is taken as one byte buffer with document offsets. Words, their hashes
and n-grams of words come from whole-array operations; no Python loop runs over
words or characters. Chunks of whole documents bound the temporary arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93

#: Bytes of text that are taken at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(ranges) -> np.ndarray:
    """A table of 256 booleans, true inside the given closed ranges of bytes."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(32))
    x *= U64(_STEP)
    x ^= x >> U64(29)
    x *= U64(_BASE)
    x ^= x >> U64(32)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, document offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, o


def doc_chunks(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges [i, j) of whole documents of about ``most`` bytes, in order."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); spans are disjoint and not empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = rel + np.repeat(starts, lens)
    val = (buf[at].astype(U64) + U64(1)) * powers(int(lens.max()))[rel]
    return mix64(np.add.reduceat(val, first) ^ (lens.astype(U64) * U64(_STEP)))


def word_spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray):
    """(starts, ends, word offsets by document) of the maximal runs of word bytes."""
    isw = word[buf]
    prev = np.empty(len(buf), bool)
    prev[1:] = isw[:-1]
    inside = offs[:-1][offs[:-1] < len(buf)]
    if len(buf):
        prev[0] = False
    prev[inside] = False
    starts = np.flatnonzero(isw & ~prev)
    last = np.empty(len(buf), bool)
    last[:-1] = isw[1:]
    if len(buf):
        last[-1] = False
    last[inside[inside > 0] - 1] = False
    ends = np.flatnonzero(isw & ~last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, word: np.ndarray):
    """(hash of each A-Z lower-cased word, word offsets by document)."""
    low = LOWER[buf]
    starts, ends, woffs = word_spans(buf, offs, word)
    return span_hashes(low, starts, ends), woffs


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words from each position (the last n - 1 are left out)."""
    if len(h) < n:
        return np.zeros(0, U64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for j in range(1, n):
        out *= U64(_BASE)
        out += h[j:j + m]
    return mix64(out + U64(n))


def gram_starts(woffs: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` words stay inside one document."""
    count = np.maximum(np.diff(woffs) - n + 1, 0)
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(first - woffs[:-1], count)


def found(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each value its place in ``sorted_keys``, or -1."""
    if not len(sorted_keys) or not len(x):
        return np.full(len(x), -1, np.int64)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    at[sorted_keys[at] != x] = -1
    return at


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def padded(buf: np.ndarray, offs: np.ndarray):
    """(bytes with one space before, between and after the documents; place of the space
    before each document, and last of the final space)."""
    out = np.full(len(buf) + len(offs), 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, len(offs)), np.diff(offs))] = buf
    return out, offs + np.arange(len(offs))


def byte_grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` <= 7 bytes from each position as one integer, with ``n`` in the top byte."""
    m = max(len(buf) - n + 1, 0)
    out = np.full(m, n << 56, U64)
    for k in range(n):
        out |= buf[k:k + m].astype(U64) << U64(8 * k)
    return out


def growing_grams(buf: np.ndarray, sizes):
    """``byte_grams`` for each of the ascending ``sizes``, each made from the one before."""
    out = np.zeros(len(buf), U64)
    at = 0
    for n in sizes:
        m = max(len(buf) - n + 1, 0)
        out = out[:m]
        for k in range(at, n):
            out = out | buf[k:k + m].astype(U64) << U64(8 * k)
        at = n
        yield out | U64(n << 56)


def gram_docs(spaces: np.ndarray, n: int):
    """(positions, offsets by document) of the n-grams inside each padded document, both of
    its spaces included; ``spaces`` as ``padded`` gives them."""
    count = np.maximum(np.diff(spaces) + 2 - n, 0)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first - spaces[:-1], count)
    return at, np.append(first, count.sum()) if len(count) else np.zeros(1, np.int64)
