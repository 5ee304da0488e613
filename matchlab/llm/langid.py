"""Language identification by language-bitmask Bloom filters of n-grams.

Learning counts the n-grams (3 and 4 bytes, letters only, A-Z lower-cased, runs of
other characters as one space each) of the labelled texts by language. The n-grams
that make up at least ``least_share`` of a language's own enter its Bloom filter, so
a filter holds at most 1 / least_share of them. The filters of all languages are
stored bit-sliced: one integer per position, with one bit per language. The AND of
an n-gram's positions is the set of languages that hold it. Per language those
bits are counted over the text, the expected false positives are taken off
(from the filter's own share of set bits), and the greatest count wins.

Learning takes a bounded sample: ``rows_per_language`` labelled rows at most on
average, chosen by a hash of id and text; more rows do not change the filters'
size. Every row is predicted from its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and
so is every text if nothing was learned; ties go to the first language in order;
null labels are not learned; repeated rows are predicted alike. Empty tables give
no rows. Up to 64 languages are learned; beyond it learning fails with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .ship import arrow_map

SIZES = (3, 4)
HASHES = 2
UNDETERMINED = "und"
#: Least part of a text's n-grams that its language must hold for ``keep_known``. At sf0.01 held-out
#: texts have 0.64 or more, their first 12 characters 0.73 or more, and some texts of other scripts 0.09 or less.
COVERAGE = 0.2

#: A letter of ASCII keeps its lower-cased byte, other bytes from 0x80 stay, the rest is a space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def _keys(buf, offs):
    """For each size the n-grams of the chunk (mixed) and their offsets by document."""
    text, spaces = vec.padded(LETTERS[buf], offs)
    blank = text == 32
    out = []
    for n in SIZES:
        at, first = vec.gram_docs(spaces, n)
        ok = ~(blank[at] & blank[at + 1])  # inside a run of spaces
        count = np.append(0, np.cumsum(ok))
        out.append((vec.mix64(vec.byte_grams(text, n)[at[ok]]), count[first]))
    return out


def _counter(batches):
    from matchlab.llm import langid as own
    from matchlab.llm import vec

    for batch in batches:
        lang = np.asarray(batch.column("lang").to_pylist(), object)
        buf, offs = vec.text_buffer(batch.column("text"))
        for i, j in vec.doc_chunks(offs):
            grams = own._keys(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            for name in sorted(set(lang[i:j])):
                mine = lang[i:j] == name
                keys = np.concatenate([k[np.repeat(mine, np.diff(first))] for k, first in grams])
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, langs: list[str], members: list[np.ndarray]):
        self.langs = langs
        most = max((len(m) for m in members), default=1)
        self.bits = max(10, int(most * 16 - 1).bit_length())
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(langs))
        self.slices = np.zeros(1 << self.bits, width)
        for lang, keys in enumerate(members):
            for k in range(HASHES):
                np.bitwise_or.at(self.slices, self.place(keys, k), width(1 << lang))
        self.false = np.array([np.mean((self.slices >> width(x)) & width(1)) ** HASHES for x in range(len(langs))])

    def place(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (keys >> np.uint64(31 * k)) & np.uint64((1 << self.bits) - 1)

    def counts(self, buf, offs):
        """(n-grams, n-grams held by each language) of each document, false positives taken off."""
        docs = len(offs) - 1
        total = np.zeros(docs)
        held = np.zeros((docs, len(self.langs)))
        for keys, first in _keys(buf, offs):
            langs = self.slices[self.place(keys, 0)]
            for k in range(1, HASHES):
                langs &= self.slices[self.place(keys, k)]
            total += np.diff(first)
            full = np.flatnonzero(np.diff(first))
            if not len(full):
                continue
            for x in range(len(self.langs)):
                one = (langs >> langs.dtype.type(x)) & langs.dtype.type(1)
                held[full, x] += np.add.reduceat(one, first[full], dtype=np.int64)
        held = np.maximum((held - total[:, None] * self.false) / (1 - self.false), 0)
        return total, held


def has_letter(buf, offs) -> np.ndarray:
    """Whether each document has a letter (of any script)."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] = kind[97:123] = 2
    kind[128:] = 1
    k = np.append(kind[buf], np.uint8(0))
    best = np.maximum.reduceat(k, offs[:-1]) if len(offs) > 1 else np.zeros(0, np.uint8)
    best[np.diff(offs) == 0] = 0
    out = best == 2
    for d in np.flatnonzero(best == 1):
        out[d] = any(c.isalpha() for c in buf[offs[d]:offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def learn(rows: DataFrame, least_share: float = 1e-5, rows_per_language: int = 5_000) -> Filters:
    """Filters from labelled ``rows`` (lang, text and any id columns to choose the sample by)."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    if not sizes:
        return Filters([], [])
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_per_language / sizes[k]))]), F.col("lang"))
    others = [c for c in rows.columns if c not in ("lang", "text")]
    dice = F.pmod(F.xxhash64(*others, F.crc32("text")), F.lit(1 << 20)) / float(1 << 20)
    counted = arrow_map(rows.where(dice < share).select("lang", "text"), _counter, "lang string, gram long, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most 1 / least_share n-grams a language
    t = {r["lang"]: r["total"] for r in total.collect()}
    floor = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, float(t.get(k, 0) * least_share))]), F.col("lang"))
    kept = grams.where(F.col("n") >= floor).select("lang", "gram").toArrow()
    name = np.asarray(kept["lang"].to_pylist(), object)
    gram = kept["gram"].to_numpy().view(np.uint64)
    return Filters(langs, [gram[name == x] for x in langs])


def _predictor(filters, cols, inside=None, least=0.0):
    def run(batches):
        from matchlab.llm import langid as own
        from matchlab.llm import vec

        f = filters.value
        names = pa.array([*f.langs, own.UNDETERMINED], pa.string())
        for batch in batches:
            text = batch.column("_id").field(inside) if inside is not None else batch.column("_text")
            buf, offs = vec.text_buffer(text)
            for i, j in vec.doc_chunks(offs):
                b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                total, held = f.counts(b, o)
                best = held.argmax(axis=1) if f.langs else np.zeros(j - i, np.int64)
                score = held.max(axis=1, initial=0) / np.maximum(held.sum(axis=1), 1e-9)
                none = ~own.has_letter(b, o) | (not f.langs) | (held.max(axis=1, initial=0) < least * total)
                best[none], score[none] = len(f.langs), 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in cols] + [names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))],
                    names=[*cols, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the language's part of all counts) of every row."""
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = d.schema["_id"].dataType.simpleString()
    out = arrow_map(d, _predictor(shared, ["_id"]), f"_id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("_id", "doc_id")


def held_out(doc_id: Column) -> Column:
    """Rows that learning leaves out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, **kw) -> DataFrame:
    """The documents (all their columns) whose text gets a language that holds at least the part
    COVERAGE of its n-grams, so texts in no learned language go."""
    f = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"), **kw)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_id"))
    shared = docs.sparkSession.sparkContext.broadcast(f)
    schema = f"_id {whole.schema['_id'].dataType.simpleString()}, lang_pred string, score double"
    out = arrow_map(whole, _predictor(shared, ["_id"], docs.columns.index("text"), COVERAGE), schema)
    return out.where(F.col("lang_pred") != UNDETERMINED).select("_id.*")
