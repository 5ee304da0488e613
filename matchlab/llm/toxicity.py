"""Toxicity: a character n-gram linear classifier with naive Bayes feature scales.

Features are hashed n-grams of 5 to 7 bytes of the lower-cased text (A-Z; white
space bytes as spaces), counted once per document. Documents with each feature
are counted by label over all training rows; r = log((p / |p|) / (q / |q|)) of the smoothed
counts scales the feature. Of the features that at least ``least_docs`` training
documents hold, the ``features`` of the greatest chi-square statistic are used, so the
model has a fixed size. A logistic regression with L2 penalty is then fitted on the
scaled features of a bounded sample of ``fit_rows`` training rows (on average,
chosen by a hash of id and text). The penalty draws the scores of the rarer label below one half, the
more so the more features there are; so the sample is dealt into ``folds`` by a hash of the text, each fold is
scored by a fit of the others, and the logistic slope and shift that these scores need are put
on the final weights. Every row is scored from its whole text.

Defined cases: null and empty texts have no feature and get the intercept's score;
labels other than 0 and 1 are not learned; several labels of one id: each joined row
counts; with no row of either label every score is the share of label 1, or 0.5 if
nothing was learned; a fold without both labels around it leaves the scores as fitted. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .ship import arrow_map

SIZES = (5, 6, 7)
BUCKETS = 1 << 20

#: Lower-cased A-Z; white space is one byte, other bytes stay.
FOLD = vec.LOWER.copy()
FOLD[[9, 10, 11, 12, 13]] = 32


def positions(buf, offs):
    """(bucket of every n-gram, offsets by document) for each size."""
    text, spaces = vec.padded(FOLD[buf], offs)
    for n, grams in zip(SIZES, vec.growing_grams(text, SIZES)):
        at, first = vec.gram_docs(spaces, n)
        yield ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.uint32)[at], first


def present(buf, offs, use: np.ndarray | None):
    """Sorted distinct (document, feature) pairs of a chunk; ``use`` maps a bucket to its
    feature, or to -1; without it the buckets are the features."""
    docs = len(offs) - 1
    kind = np.uint32 if docs <= 1 << 12 else np.uint64  # document and feature in one number
    pairs = []
    for f, first in positions(buf, offs):
        if use is None:
            doc = np.repeat(np.arange(docs, dtype=kind), np.diff(first))
        else:
            f = use[f]
            at = np.flatnonzero(f >= 0)
            doc, f = (np.searchsorted(first, at, side="right") - 1).astype(kind), f[at]
        pairs.append(doc << kind(20) | f.astype(kind))
    p = np.concatenate(pairs)
    p.sort()
    p = p[np.append(True, p[1:] != p[:-1])] if len(p) else p
    return (p >> kind(20)).astype(np.int64), (p & kind((1 << 20) - 1)).astype(np.int64)


def _counter(batches):
    """Documents with each bucket by label, summed over the task."""
    from matchlab.llm import toxicity as own
    from matchlab.llm import vec

    counts = np.zeros((2, own.BUCKETS), np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        buf, offs = vec.text_buffer(batch.column("text"))
        for i, j in vec.doc_chunks(offs):
            doc, f = own.present(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], None)
            for y in (0, 1):
                counts[y] += np.bincount(f[label[i:j][doc] == y], minlength=own.BUCKETS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["f", "q", "p"])


def _lister(use):
    def run(batches):
        from matchlab.llm import toxicity as own
        from matchlab.llm import vec

        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("text"))
            for i, j in vec.doc_chunks(offs):
                doc, f = own.present(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], use.value)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("label", "fold")),
                                                  vec.lists(first, pa.array(f.astype(np.int32)))], names=["label", "fold", "f"])
    return run


class Model:
    """``use``: feature of each bucket, or -1; ``weight`` of each feature; ``bias``."""

    def __init__(self, use, weight, bias):
        self.use, self.weight, self.bias = use, weight, bias

    def scores(self, buf, offs) -> np.ndarray:
        doc, f = present(buf, offs, self.use)
        z = np.bincount(doc, self.weight[f], minlength=len(offs) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(label, first, f, scale, l2: float, rounds: int = 300):
    """(weights of the scaled features, bias) by accelerated gradient descent on the logistic
    loss plus l2 / 2 of the squared weights; all rows in each round. A step that raises the loss isn't
    taken: the momentum starts again, and if there is none the steps are halved."""
    n, m = len(label), len(scale)
    doc = np.repeat(np.arange(n), np.diff(first))
    x = scale[f]

    def loss(w, z):
        return np.sum(np.logaddexp(0, z) - label * z) + l2 / 2 * (w @ w)
    # the greatest row norm: the curvature where rows share few features, else the halving finds it
    step, rate = 1 / ((np.bincount(doc, x * x, minlength=n).max(initial=0) + 1) / 4 + l2), 1.0
    w, b = np.zeros(m), np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6))
    z = np.full(n, b)
    vw, vb, vz, least, k = w, b, z, loss(w, z), 0
    for _ in range(rounds):
        err = 1 / (1 + np.exp(-np.clip(vz, -30, 30))) - label
        nw = vw - rate * step * (np.bincount(f, x * err[doc], minlength=m) + l2 * vw)
        nb = vb - rate * 4 * err.sum() / n
        nz = np.bincount(doc, x * nw[f], minlength=n) + nb
        new = loss(nw, nz)
        if new > least:
            if k == 0:
                rate /= 2
            vw, vb, vz, k = w, b, z, 0
            continue
        c = k / (k + 3)
        vw, vb, vz = nw + c * (nw - w), nb + c * (nb - b), nz + c * (nz - z)
        w, b, z, least, k = nw, nb, nz, new, k + 1
    return w, b


def out_of_fold(label, fold, first, f, scale, l2: float) -> np.ndarray | None:
    """Log-odds of every row by a fit of the rows of the other folds; None if some fit lacks a label."""
    size, out = np.diff(first), np.zeros(len(label))
    row = np.repeat(np.arange(len(label)), size)
    for k in np.unique(fold):
        rest = fold != k
        if len(np.unique(label[rest])) < 2:
            return None
        w, b = fit_logistic(label[rest], np.append(0, np.cumsum(size[rest])), f[rest[row]], scale, l2)
        z = np.bincount(row, (w * scale)[f], minlength=len(label)) + b
        out[~rest] = z[~rest]
    return out


def slope_and_shift(z: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of the least logistic loss of a * z + b, plus half the square of (a - 1, b), by Newton
    steps that are halved until the loss falls; (1, 0) if the best slope isn't positive."""
    x = np.stack([z, np.ones(len(z))])

    def loss(t):
        u = t @ x
        return np.sum(np.logaddexp(0, u) - label * u) + ((t[0] - 1) ** 2 + t[1] ** 2) / 2
    t = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.eye(2), x @ (p - label) + t - [1, 0])
        while np.abs(step).max() > 1e-9 and loss(t - step) > loss(t):
            step /= 2
        t = t - step
        if np.abs(step).max() <= 1e-9:
            break
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def learn(rows: DataFrame, features: int = 8_192, least_docs: int = 5, fit_rows: int = 20_000, l2: float = 1.0, folds: int = 2) -> Model:
    """A model from labelled ``rows``: text, label (0 or 1) and id columns to choose the sample by."""
    rows = rows.where("label IN (0, 1)").withColumn("label", F.col("label").cast("int"))
    spark = rows.sparkSession
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    none = np.full(BUCKETS, -1, np.int64)
    if not n0 or not n1:
        return Model(none, np.zeros(1), 0.0 if not sizes else (30.0 if n1 else -30.0))
    counted = arrow_map(rows.select("label", "text"), _counter, "f long, q long, p long")
    # one row for each bucket at most
    c = counted.groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).where(F.col("p") + F.col("q") >= least_docs).toArrow()
    f, q, p = (c[x].to_numpy().astype(np.float64) for x in ("f", "q", "p"))
    order = np.argsort(f)
    f, q, p = f[order].astype(np.int64), q[order], p[order]
    n = n0 + n1
    chi = n * (p * (n0 - q) - q * (n1 - p)) ** 2 / ((p + q) * (n - p - q) * n0 * n1 + 1e-9)
    top = np.sort(np.argsort(-chi, kind="stable")[:features])
    r = np.log((p[top] + 1) / (n1 + 2)) - np.log((q[top] + 1) / (n0 + 2))
    use = none
    use[f[top]] = np.arange(len(top))
    others = [x for x in rows.columns if x not in ("label", "text")]
    dice = F.pmod(F.xxhash64(*others, F.crc32("text")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(dice < min(1.0, fit_rows / n)).select("label", "text", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"))
    got = arrow_map(sample, _lister(spark.sparkContext.broadcast(use)), "label int, fold int, f array<int>").toArrow()
    lists = got["f"].combine_chunks()
    first = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0] if len(lists) else np.zeros(1, np.int64)
    label = got["label"].to_numpy().astype(np.float64)
    if not len(label) or not len(top):
        return Model(none, np.zeros(1), float(np.log(n1 / n0)))
    held = lists.flatten().to_numpy().astype(np.int64)
    w, b = fit_logistic(label, first, held, r, l2)
    z = out_of_fold(label, got["fold"].to_numpy(), first, held, r, l2) if folds > 1 else None
    a, shift = (1.0, 0.0) if z is None else slope_and_shift(z, label)
    return Model(use, a * w * r, float(a * b + shift))


def _scorer(model):
    def run(batches):
        from matchlab.llm import vec

        m = model.value
        for batch in batches:
            buf, offs = vec.text_buffer(batch.column("_text"))
            for i, j in vec.doc_chunks(offs):
                s = m.scores(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(s)], names=["_id", "score"])
    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = d.schema["_id"].dataType.simpleString()
    return arrow_map(d, _scorer(shared), f"_id {kind}, score double").withColumnRenamed("_id", "doc_id")


def held_out(doc_id: Column) -> Column:
    """Rows that learning leaves out: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Labels that may be broadcast to pick the training texts; beyond it Spark joins by shuffle.
BROADCAST_LABELS = 1_000_000


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that learning may see."""
    y = labels.select(F.col("doc_id").alias("_y"), F.col("toxic").alias("label")).where(~held_out(F.col("_y")) & F.col("label").isin(0, 1))
    y = F.broadcast(y) if y.count() <= BROADCAST_LABELS else y
    d = docs.select("doc_id", "text")
    return d.join(y, d["doc_id"] == y["_y"]).select("doc_id", "text", "label")
