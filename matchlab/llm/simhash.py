"""Document fingerprints by SimHash (DataFrame functions only).

The terms of a text are its pairs of consecutive words (one word: that word),
lower-cased; a term weighs as often as it occurs. Every occurrence votes on the 64
bits of the fingerprint with the bits of its hash. Votes are counted for two bits at
a time, in the halves of a long, so one aggregation over the exploded terms gives
all of them and only one row per document is shuffled.

The search for fingerprints within 3 bits uses permuted block tables: the 64 bits
are cut into 6 blocks; any 3 differing bits leave 3 blocks equal, so one table for
each choice of 3 blocks (20 tables, keys of 31 to 33 bits) meets every such pair.
Equal fingerprints are one entry of a table.

Defined cases: a null text is empty; a text without words has fingerprint 0; equal
texts have equal fingerprints. Rows that repeat id and text count once; rows of one
id and different texts are documents of their own, ordered by a hash of the text.
A null id comes first. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_next
from .store import written

BITS = 64
SHINGLE = 2
RADIUS = 3
#: Blocks of the fingerprint: first bit and width.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fingerprint (64-bit, as a long) of each row's text; ``keys`` name one
    text each, else the votes of their texts add up."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    t = texts.select(*keys, words.alias("_w"))
    n = F.size("_w")
    last = F.greatest(n - SHINGLE + 1, F.lit(1))
    names = [f"w{k}" for k in range(SHINGLE)]
    cols = [F.slice("_w", 1 + k, last).alias(names[k]) for k in range(SHINGLE)]
    t = t.select(*keys, *cols).select(*keys, F.inline_outer(F.arrays_zip(*names)))
    h = F.xxhash64(*names)
    t = t.select(*keys, F.when(F.col("w0").isNotNull(), h).alias("h"))
    # the hash is shifted first, so lane masks keep bit b and bit b + 32
    lanes = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(0x100000001))).alias(f"v{b}") for b in range(32)]
    g = t.groupBy(*keys).agg(F.count("h").alias("n"), *lanes)

    def bit(b: int) -> Column:
        ones = F.col(f"v{b}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftrightunsigned(f"v{b - 32}", 32)
        return F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    halves = []
    for at in (0, 32):
        out = bit(at)
        for b in range(at + 1, at + 32):
            out = out.bitwiseOR(bit(b))
        halves.append(out)
    return g.select(*keys, halves[0].alias("_lo"), halves[1].alias("_hi")) \
        .select(*keys, F.col("_lo").bitwiseOR(F.col("_hi")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def _block(fp: Column, k: int) -> Column:
    at, width = BLOCKS[k]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _tables(fp: str) -> Column:
    rows = []
    for t, chosen in enumerate(TABLES):
        key = F.lit(t).cast("long")
        for k in chosen:
            key = F.shiftleft(key, BLOCKS[k][1]).bitwiseOR(_block(F.col(fp), k))
        rows.append(key)
    return F.array(*rows)


def _first_table(x: Column) -> Column:
    """Of the tables in which two fingerprints with this difference meet, the first."""
    out = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(TABLES))):
        same = F.lit(True)
        for k in chosen:
            same = same & (_block(x, k) == 0)
        out = F.when(same, t).otherwise(out)
    return out


def within_radius(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, found, distance) for every fingerprint of ``index`` within 3 bits of one of
    ``queries``; both have a column fingerprint, whose values count once each."""
    q = queries.select("fingerprint").distinct().select(F.col("fingerprint").alias("query"))
    q = q.select("query", F.posexplode(_tables("query")).alias("t", "key"))
    i = index.select("fingerprint").distinct().select(F.col("fingerprint").alias("found"))
    i = i.select("found", F.posexplode(_tables("found")).alias("u", "key"))
    x = F.col("query").bitwiseXOR(F.col("found"))
    near = (F.bit_count(x) <= RADIUS) & (F.col("t") == _first_table(x))
    return q.join(i, (q["key"] == i["key"]) & near).select("query", "found", F.bit_count(x).alias("distance"))


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """doc_id, _th (text hash), n_chars, text, edited (the last n_chars / part code points
    replaced by the first ones of the next document) and next (doc_id, _th)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("_th", F.xxhash64("text"))
    ids = d.groupBy("doc_id", "_th").agg(F.max(F.char_length("text")).alias("n_chars"))
    links = written(with_next(ids, ["doc_id", "_th"], wrap=True), "next-documents")
    # the next document's text is cut to what the edit takes of it before it moves
    at = (F.col("l.next.doc_id").eqNullSafe(F.col("d.doc_id"))) & (F.col("l.next._th") == F.col("d._th"))
    heads = d.alias("d").join(links.alias("l"), at).select(
        F.col("l.doc_id").alias("doc_id"), F.col("l._th").alias("_th"), "l.n_chars", "l.next",
        F.left("d.text", F.floor(F.col("l.n_chars") / part).cast("int")).alias("_head"))
    own = (F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))) & (F.col("d._th") == F.col("h._th"))
    cut = F.col("h.n_chars") - F.floor(F.col("h.n_chars") / part)
    return d.alias("d").join(heads.alias("h"), own).select(
        "d.doc_id", "d._th", "h.n_chars", "h.next", "d.text",
        F.concat(F.left("d.text", cut.cast("int")), "h._head").alias("edited"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (longs), next_fingerprint."""
    e = with_edits(docs, doc_id, text)
    both = e.select("doc_id", "_th", "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                                      F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("b"))
    keys = ["doc_id", "_th", "next", "n_chars", "edited_sha256", "kind"]
    fp = fingerprints(both.select(*keys[:-1], "b.kind", "b.body"), keys, "body")
    fp = fp.groupBy(*keys[:2]).agg(
        F.first("next").alias("next"), F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    fp = written(fp, "fingerprints")
    other = fp.select(F.col("doc_id").alias("o_id"), F.col("_th").alias("o_th"), F.col("fingerprint").alias("next_fingerprint"))
    return fp.join(other, F.col("next.doc_id").eqNullSafe(F.col("o_id")) & (F.col("next._th") == F.col("o_th"))) \
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
