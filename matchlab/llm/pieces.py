"""SentencePiece encoding with seeded merge dropout, and decoding.

Texts are segmented by the merges of a SentencePiece BPE model. Its agenda takes the
adjacent pair of the best score, leftmost first; each candidate merge is skipped for
good if a keyed hash of its occurrence and extent falls under the dropout rate. The
key holds the seed, a hash of the text and the word's place in it, so each occurrence
of a word is cut on its own, while every run gives the same pieces. Rate 0 gives the
model's own segmentation.

No piece of such a model holds a space after another character, so words (spaces,
then other characters) are segmented alone. The occurrences of a word share the rows
of a matrix as long as their merges went the same way: a row's best merge is found
once, each of its occurrences decides by its own key whether to skip it, and the row
is split in two where they differ. Rows are taken by length, longest first, and a
merge moves a row to the next length. Words of more than ``LONG`` characters go
through an agenda of their own, one an occurrence, with the same result.

Decoding joins the pieces' bytes. Characters without a piece, and U+2581 (the mark
that stands for a space), are encoded as byte pieces, so decoding gives the text
back exactly; every document is decoded and compared.

Defined cases: null and empty texts have no pieces; repeated rows give equal pieces.
Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .ship import arrow_map

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NO_PIECE = 0xFFFF
LONG = 48
_FAR = np.int64(1) << 62
_K = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_M64 = (1 << 64) - 1


class Pieces:
    """Tables of a model: character pieces, pairs that merge, bytes of each piece."""

    def __init__(self, model: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        if n > NO_PIECE:
            raise ValueError("the tables hold models of fewer than 65,535 pieces")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = {t: i for i, t in enumerate(text) if not special[i] and not sp.is_byte(i)}
        if any(MARK in t.lstrip(MARK) for t in normal):
            raise ValueError("pieces of the model cross words")
        self.byte_ids = np.zeros(256, np.uint16)
        raw = []
        for i, t in enumerate(text):
            if sp.is_byte(i):
                b = int(t[3:-1], 16)
                self.byte_ids[b] = i
                raw.append(bytes([b]))
            else:
                raw.append(b"" if special[i] else t.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.chars = np.full(0x110000, NO_PIECE, np.uint16)
        for t, i in normal.items():
            if len(t) == 1:
                self.chars[ord(t)] = i
        self.chars[0x20] = self.chars[ord(MARK)]
        self.chars[ord(MARK)] = NO_PIECE
        pairs = {}
        for t, i in normal.items():
            for k in range(1, len(t)):
                a, b = normal.get(t[:k]), normal.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = (i, int(-sp.get_score(i)))
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key = keys
        self.pair_id = np.array([pairs[k][0] for k in keys.tolist()], np.uint16)
        self.pair_rank = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        # place of the first key at each slot; keys that find their slot taken are searched
        slot = self._slot(keys)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(keys))[::-1]
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[slot[self.slots[slot] != np.arange(len(keys))]] = True

    @staticmethod
    def _slot(key):
        return ((key.astype(np.uint64) * np.uint64(_K[0])) >> np.uint64(44)).astype(np.int64)

    def find(self, a, b):
        """Place of each pair in the pair tables, or -1."""
        key = (a.astype(np.int64) << 16) | b
        slot = self._slot(key)
        at = self.slots[slot].astype(np.int64)
        miss = (at < 0) | (self.pair_key[at] != key)
        again = np.flatnonzero(miss & self.crowded[slot])
        at[miss] = -1
        if len(again):
            at[again] = vec.found(self.pair_key, key[again])
        return at


def _skips(key, start, mid, end, rate):
    """Whether each candidate merge is skipped; integer arrays, key 64-bit."""
    x = key + start.astype(np.uint64) * np.uint64(_K[0]) + mid.astype(np.uint64) * np.uint64(_K[1]) + end.astype(np.uint64) * np.uint64(_K[2])
    return (vec.mix64(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _ranks(p: Pieces, left, right):
    at = p.find(left, right)
    return np.where(at >= 0, p.pair_rank[at], _FAR), at


def merge_matrix(p: Pieces, words: dict, word: np.ndarray, key: np.ndarray, rate: float):
    """Segments occurrences of words: (occurrences, their row, word, pieces, starts of each row) for
    each finished group of rows.

    ``words`` has, by length, the numbers of distinct words and the matrix of their characters;
    ``word`` and ``key`` hold the word and the key of each occurrence."""
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(word[order], np.arange(int(word.max(initial=-1)) + 2))
    moved = None  # rows that a merge has brought to this length
    for k in range(max(words, default=0), 0, -1):
        parts = [moved] if moved else []
        moved = None
        if k in words:
            w, sym = words[k]
            n = len(w)
            start = np.broadcast_to(np.arange(k + 1, dtype=np.int32), (n, k + 1))
            rank, at = _ranks(p, sym[:, :-1].ravel(), sym[:, 1:].ravel())
            count = first[w + 1] - first[w]
            parts.append((order[_spread(first[w], count)], np.repeat(np.arange(n), count), w, sym, start, rank.reshape(n, k - 1), at.reshape(n, k - 1)))
        if not parts:
            continue
        base = np.cumsum([0] + [len(x[2]) for x in parts])
        occ, row = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + b for x, b in zip(parts, base)])
        w, sym, start, rank, at = (np.concatenate([x[c] for x in parts]) for c in range(2, 7))
        if k == 1:
            yield occ, row, w, sym, start[:, :-1]
            return
        merged = []
        while len(w):
            q = rank.argmin(axis=1)
            go = rank[np.arange(len(w)), q] < _FAR
            if not go.all():
                mine, new = go[row], np.where(go, np.cumsum(go), np.cumsum(~go)) - 1
                yield occ[~mine], new[row[~mine]], w[~go], sym[~go], start[~go, :-1]
                occ, row = occ[mine], new[row[mine]]
                w, sym, start, rank, at, q = (x[go] for x in (w, sym, start, rank, at, q))
                if not len(w):
                    break
            i = np.arange(len(w))
            if rate > 0:
                skip = _skips(key[occ], *(start[i, q + c][row] for c in range(3)), rate)
            else:
                skip = np.zeros(len(occ), bool)
            # occurrences that merge take their row to the next length; the others go on without the pair
            has = np.zeros(len(w), bool)
            has[row[~skip]] = True
            merged.append((occ[~skip], (np.cumsum(has) - 1)[row[~skip]], w[has], *_merge(p, sym[has], start[has], rank[has], at[has], q[has])))
            rank[i, q] = _FAR
            has = np.zeros(len(w), bool)
            has[row[skip]] = True
            occ, row = occ[skip], (np.cumsum(has) - 1)[row[skip]]
            w, sym, start, rank, at = (x[has] for x in (w, sym, start, rank, at))
        if merged:
            base = np.cumsum([0] + [len(x[2]) for x in merged])
            moved = (np.concatenate([x[0] for x in merged]), np.concatenate([x[1] + b for x, b in zip(merged, base)]),
                     *(np.concatenate([x[c] for x in merged]) for c in range(2, 7)))


def _merge(p: Pieces, sym, start, rank, at, q):
    """Rows after the merge of their pair ``q``."""
    n, k = sym.shape
    i = np.arange(n)
    new = p.pair_id[at[i, q]]
    pick = np.arange(k - 1) + (np.arange(k - 1) > q[:, None])
    sym = np.take_along_axis(sym, pick, 1)
    sym[i, q] = new
    start = np.concatenate([np.take_along_axis(start, pick, 1), start[:, -1:]], 1)
    pick = np.arange(k - 2) + (np.arange(k - 2) >= q[:, None])
    rank, at = np.take_along_axis(rank, pick, 1), np.take_along_axis(at, pick, 1)
    for shift in (-1, 0):  # the pairs that the new piece is part of
        c = q + shift
        m = np.flatnonzero((c >= 0) & (c < k - 2))
        if len(m):
            rank[m, c[m]], at[m, c[m]] = _ranks(p, sym[m, c[m]], sym[m, c[m] + 1])
    return sym, start, rank, at


def merge_agenda(p: Pieces, sym: np.ndarray, key, rate: float):
    """Segments one word by an agenda of candidate merges: (pieces, starts)."""
    n = len(sym)
    ids, ends, prev, nxt = sym.astype(int).tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, agenda = [True] * n, []
    key = np.uint64(key)

    def offer(lefts):
        if not lefts:
            return
        a = np.array(lefts)
        b = np.array([nxt[x] for x in lefts])
        ea, eb = np.array([ends[x] for x in lefts]), np.array([ends[x] for x in b])
        rank, at = _ranks(p, np.array([ids[x] for x in a]), np.array([ids[x] for x in b]))
        if rate > 0:
            rank[_skips(np.full(len(a), key), a, ea, eb, rate)] = _FAR
        for x, y, r, t, e in zip(a.tolist(), b.tolist(), rank.tolist(), at.tolist(), eb.tolist()):
            if r < _FAR:
                heapq.heappush(agenda, (r, x, y, ends[x], e, int(p.pair_id[t])))

    offer([x for x in range(n) if nxt[x] < n])
    while agenda:
        _, x, y, ex, ey, new = heapq.heappop(agenda)
        if not (alive[x] and y < n and alive[y] and ends[x] == ex and ends[y] == ey and nxt[x] == y):
            continue  # one of its pieces was merged meanwhile
        ids[x], ends[x], alive[y], nxt[x] = new, ends[y], False, nxt[y]
        if nxt[x] < n:
            prev[nxt[x]] = x
        offer([v for v in (prev[x], x) if v >= 0 and nxt[v] < n])
    at = [x for x in range(n) if alive[x]]
    return np.array([ids[x] for x in at], np.uint16), np.array(at, np.int64)


def _code_points(b: np.ndarray, lead: np.ndarray):
    """Code point at each lead byte of valid UTF-8."""
    b = np.append(b, np.zeros(3, np.uint8)).astype(np.int64)
    c = b[lead]
    out = c.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        m = c >= low
        v = c[m] & mask
        for k in range(1, size):
            v = v << 6 | (b[lead[m] + k] & 0x3F)
        out[m] = v
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for all i, in one array."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(before - first, count)


def encode(p: Pieces, buf: np.ndarray, offs: np.ndarray, seed: int, rate: float, variants: int | None = None):
    """(pieces, offsets by document) of a chunk of whole documents. ``variants`` has no effect:
    nothing bounds the segmentations of a word."""
    docs = len(offs) - 1
    # a space before each document that isn't empty
    size = np.diff(offs)
    o = np.append(0, np.cumsum(size + (size > 0)))
    text = np.full(int(o[-1]), 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(np.cumsum(size > 0), size)] = buf
    if not len(text):
        return np.zeros(0, np.uint16), np.zeros(docs + 1, np.int64), text, o
    space = text == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[o[:-1][size > 0]] = True
    ws = np.flatnonzero(head)
    we = np.append(ws[1:], len(text))
    h = vec.span_hashes(text, ws, we)
    wo = np.searchsorted(ws, o)
    full = np.flatnonzero(size)
    count = np.diff(wo)
    place = np.arange(len(ws)) - np.repeat(wo[:-1], count)
    doc_key = np.zeros(docs, np.uint64)
    doc_key[full] = np.add.reduceat(vec.mix64(h + place.astype(np.uint64) * np.uint64(_K[1])), wo[full])
    s = np.uint64(seed & _M64)
    # one key an occurrence: nothing but the skips of its own merges depends on it
    key = vec.mix64(h ^ vec.mix64(vec.mix64(np.repeat(doc_key, count) + s) + place.astype(np.uint64)))
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)

    at = _spread(ws[one], (we - ws)[one])
    b = text[at]
    wb = np.append(0, np.cumsum((we - ws)[one]))
    is_lead = (b & 0xC0) != 0x80
    lead = np.flatnonzero(is_lead)
    cp = _code_points(b, lead)
    sym = p.chars[cp]
    wc = np.append(0, np.cumsum(is_lead))[wb]  # characters before each word
    chars = np.diff(wc)
    short = chars <= LONG
    words = {}
    for n in np.unique(chars[short]):
        w = np.flatnonzero(chars == n)
        words[int(n)] = w, sym[wc[w][:, None] + np.arange(n)]
    parts, made = [], 0  # (word, pieces, starts) of the segmentations, and which one each occurrence has
    of = np.zeros(len(ws), np.int64)
    mine = np.flatnonzero(short[inverse])
    for occ, row, w, ids, starts in merge_matrix(p, words, inverse[mine], key[mine], rate):
        of[mine[occ]] = row + made
        parts.append((w, ids, starts))
        made += len(w)
    for x in np.flatnonzero(~short[inverse]):
        w = inverse[x]
        ids, starts = merge_agenda(p, sym[wc[w]:wc[w + 1]], key[x], rate)
        of[x] = made
        parts.append((np.array([w]), ids[None], starts[None]))
        made += 1
    inverse = of
    widths = np.concatenate([np.full(len(w), i.shape[1], np.int64) for w, i, _ in parts])
    first = np.cumsum(widths) - widths
    ids, char = np.zeros(int(widths.sum()), np.uint16), np.zeros(int(widths.sum()), np.int64)
    row = 0
    for w, i, st in parts:
        put = first[row:row + len(w), None] + np.arange(i.shape[1])
        ids[put], char[put] = i, st + wc[w][:, None]
        row += len(w)
    # characters without a piece as their bytes
    width = np.diff(np.append(lead, len(b)))
    none = ids == NO_PIECE
    times = np.where(none, width[char], 1)
    out = np.repeat(ids, times)
    out[np.repeat(none, times)] = p.byte_ids[b[_spread(lead[char[none]], times[none])]]
    ends = np.append(0, np.cumsum(times))
    first, last = ends[first], ends[first + widths]
    each = (last - first)[inverse]
    all_ids = out[_spread(first[inverse], each)]
    return all_ids, np.append(0, np.cumsum(each))[wo], text, o


def decode(p: Pieces, ids: np.ndarray, offs: np.ndarray):
    """(bytes, offsets by document) of pieces; the space before each document is still there."""
    n = p.raw_len[ids]
    return p.raw[_spread(p.raw_at[ids], n)], np.append(0, np.cumsum(n))[offs]


def same_docs(a, ao, b, bo) -> np.ndarray:
    """Which documents are equal byte for byte."""
    same = np.diff(ao) == np.diff(bo)
    if same.all():
        wrong = np.append(0, np.cumsum(a != b))
        return wrong[ao[1:]] == wrong[ao[:-1]]
    return np.array([s and np.array_equal(a[ao[i]:ao[i + 1]], b[bo[i]:bo[i + 1]]) for i, s in enumerate(same)])


#: Bytes of text taken at once; the occurrences of a word in a chunk share their equal steps.
CHUNK = 2 << 20


def _encoder(tables, seed, rate):
    def run(batches):
        from matchlab.llm import pieces as own
        from matchlab.llm import vec

        p = tables.value
        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("_text"))
            for i, j in vec.doc_chunks(offs, own.CHUNK):
                ids, po, text, to = own.encode(p, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], seed, rate)
                back, bo = own.decode(p, ids, po)
                same = own.same_docs(back, bo, text, to)
                if not same.all():
                    raise ValueError("pieces do not decode to their text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), pa.array(np.diff(po)), vec.lists(po, pa.array(ids.astype(np.int32)))],
                    names=["_id", "n_pieces", "pieces"])
    return run


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = 1,
                 rate: float = 0.1, variants: int | None = None) -> DataFrame:
    """doc_id, n_pieces and pieces (ids) of every row. Fails if a text isn't decoded exactly.
    ``variants`` has no effect (see ``encode``)."""
    tables = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    out = arrow_map(d, _encoder(tables, seed, rate), f"_id {kind}, n_pieces long, pieces array<int>")
    return out.withColumnRenamed("_id", "doc_id")


def _decoder(tables):
    def run(batches):
        from matchlab.llm import pieces as own

        p = tables.value
        for batch in batches:
            col = batch.column("pieces").fill_null([]) if batch.column("pieces").null_count else batch.column("pieces")
            offs = np.asarray(col.offsets, np.int64)
            ids = col.flatten().to_numpy(zero_copy_only=False)
            back, bo = own.decode(p, ids, offs - offs[0])
            texts = [back[a + 1:b].tobytes().decode() if b > a else "" for a, b in zip(bo[:-1], bo[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])
    return run


def decode_pieces(rows: DataFrame, doc_id: str = "doc_id", pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of pieces; null pieces count as none."""
    tables = rows.sparkSession.sparkContext.broadcast(Pieces(model))
    d = rows.select(F.col(doc_id).alias("_id"), F.col(pieces).alias("pieces"))
    kind = d.schema["_id"].dataType.simpleString()
    return arrow_map(d, _decoder(tables), f"_id {kind}, text string").withColumnRenamed("_id", "doc_id")
