"""Filter interaction audit, exact top-k search and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlab.llm import filter_audit, maxscore, runs, runs_query, search_query

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string, mask int, digest string, id string, part string, n int, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 3, "x", "y", "z", 4, 5) for i, t, s in rows], DOCS)


def brute_fails(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        out.append(f)
    return out


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    fails = brute_fails(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), sum(x in f for _, f in mine) - len(here), sum(f == x for _, f in mine),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), x]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(90)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "Word", ""), (4, "SHOUT # now", "b"), (5, long, "b"), (6, long, "a"),
            (6, long, "b"), (None, long, "a"), (None, long, "a"), (None, None, None), (7, "ÄÖ 漢字 😀\x0bx", "c"), (-3, "ÄÖ 漢字 😀\x0bx", "c")]
    for k in range(60):
        n = rng.choice([3, 49, 50, 51, 80])
        t = " ".join(rng.choice(words[:rng.choice([5, 90])]) for _ in range(n)) + rng.choice(["", "", " A B C D E F G", "$"])
        rows += [(100 + k, t, rng.choice("ab"))] * rng.choice([1, 1, 1, 2])
        if k % 4 == 0:
            rows.append((1000 - k, t, rng.choice("abc")))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if rng.random() < 0.6] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    return rows, labels


def test_audit_equals_applying_every_order(spark):
    rows, labels = audit_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p")).withColumn("good", F.lit(9))
    got = filter_audit.audit(filter_audit.failures(documents(spark, rows), lab)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"],
                                                       r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert got == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(documents(spark, []), labels)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 5])
def test_removal_intervals_hold_each_order_once(k):
    orders = list(permutations(range(k)))
    want = sorted((m, next(s for s, x in enumerate(o, 1) if m >> x & 1), r) for r, o in enumerate(orders) for m in range(1, 1 << k))
    assert sorted((m, s, r) for m, s, lo, hi in filter_audit.removal_intervals(k) for r in range(lo, hi)) == want


def test_audit_of_other_masks(spark):
    counts = spark.createDataFrame([("p", 0, 7, 1, 0), ("p", 3, 5, 2, 1), ("p", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"]) for r in filter_audit.audit(counts, "xy").collect()}
    assert got == {("xy", 1): (11, 5, 0, 0), ("xy", 2): (7, 4, 5, 4), ("yx", 1): (7, 9, 0, 4), ("yx", 2): (7, 0, 5, 0)}


VECTORS = "vec_id long, embedding array<float>, row string, id int, v string, score int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "r", 1, "v", 2, 3) for i, v in rows], VECTORS)


def brute_search(rows, k):
    ok = [(n, i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j) for m, j, v in ok if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def search(df, k=5):
    got = maxscore.top_k(df, F.col("id") % 50 == 0, k)
    return sorted([tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()], key=str)


def vector_rows(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, dims)]) for i in rng.permutation(n)]
    same = [0.5] * dims
    return rows + [(1000 + k, same) for k in range(30)] + [(1050, same), (50, same), (50, rows[3][1]), (None, same), (None, rows[4][1])]


def test_search_equals_all_inner_products(spark, monkeypatch):
    odd = [(2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (2200, []), (2250, [1.0, -1.0]),
           (2300, [0.25] * 12), (2301, [0.0] * 8), (2350, [0.0] * 8), (-50, [-0.3] * 8)]
    rows = vector_rows(300, 8) + odd
    assert search(vectors(spark, rows)) == brute_search(rows, 5)
    monkeypatch.setattr(maxscore, "BLOCK", 40)  # several blocks of queries
    assert search(vectors(spark, rows).repartition(5), 3) == brute_search(rows, 3)


def test_search_with_few_or_no_candidates(spark):
    assert search(vectors(spark, [])) == []
    assert search(vectors(spark, [(0, [1.0])])) == []
    assert search(vectors(spark, [(1, [1.0]), (2, [2.0])])) == []
    assert search(vectors(spark, [(0, [1.0]), (2, [2.0]), (None, [3.0])])) == [(0, 1, None, 256 * 768), (0, 2, 2, 256 * 512)]


def test_search_of_large_components(spark):
    rows = [(0, [3e6, -2e6]), (1, [1e6, 1.0]), (2, [2e6, 2e6]), (50, [1e5, -1e5])]
    assert search(vectors(spark, rows)) == brute_search(rows, 5)


@pytest.mark.parametrize("scale", [1, 40, 1 << 20])
def test_shard_finds_all_that_reach_a_threshold(scale):
    rng = np.random.default_rng(scale)
    v = rng.integers(-scale, scale + 1, (500, 17))
    shard = maxscore.Shard(v)
    for q in rng.integers(-scale, scale + 1, (20, 17)):
        s = v @ q
        for least in (maxscore.NEVER, int(np.sort(s)[-7]), int(s.max()) + 1, 0):
            at, score = shard.search(q, least)
            assert list(at) == list(np.flatnonzero(s >= least)) and list(score) == list(s[at])


def test_probing_stops_for_what_is_not_competitive():
    """Terms of wide bounds first: the narrow ones are non-essential and probed for few vectors."""
    v = np.zeros((1000, 40), np.int64)
    v[:, 0] = np.arange(1000)
    v[:, 1:] = np.random.default_rng(0).integers(0, 3, (1000, 39))
    q = np.ones(40, np.int64)
    s = v @ q
    at, score = maxscore.Shard(v).search(q, int(np.sort(s)[-5]))
    assert set(score) <= set(s[np.argsort(s)[-5:]]) and len(at) >= 5


def test_search_query_reads_the_table(spark, tmp_path):
    rows = [r for r in vector_rows(120, 6) if r[0] is not None and r[0] != 50]
    vectors(spark, rows).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = search_query.op12_top_k(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(rows, 5)


def brute_runs(w, exponent=4, least=6):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    rng = random.Random(11)
    texts = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", " ".join("aab" * 5), "A a A a A a A a",
             "x " + "a " * 40 + "b " + "a " * 40, "ü 漢 " * 9 + "\x0b😀", ("a b " * 6 + "c ") * 5, "a\nb\tc " * 200, "q " * 3000, "m n o " * 1000 + "p"]
    for n in range(60):
        w = [rng.choice("abcd"[:rng.choice([2, 4])]) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randrange(len(w)), rng.randint(1, 30)
            w[at:at] = (w[at:at + p] or ["z"]) * rng.randint(2, 9)
        texts.append(" ".join(w))
    texts.append(" ".join(f"u{rng.randrange(3000)}" for _ in range(4000)) + " " + " ".join(f"v{k % 777}" for k in range(4000)))
    return texts


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_runs_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(runs, "CELLS", cells)
    for t in periodic_texts():
        w = re.findall(SPACE, t or "")
        ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
        h = runs.vec.mix64(np.array([ids[x] + 9 for x in w], np.uint64))
        got = [(s, e - s, p) for s, e, p in runs.find_runs(h, len(w)).tolist()]
        assert got == brute_runs(w), t[:80]


def test_runs_of_squares_and_cubes():
    rng = random.Random(2)
    for exponent, least in ((2, 2), (2, 5), (3, 1)):
        for _ in range(60):
            w = [rng.randrange(3) for _ in range(rng.randint(0, 90))]
            h = runs.vec.mix64(np.array(w, np.uint64) + np.uint64(5))
            got = [(s, e - s, p) for s, e, p in runs.find_runs(h, len(w), exponent, least).tolist()]
            assert got == brute_runs(w, exponent, least), w


def test_runs_and_collapsed_texts_of_documents(spark):
    rows = [(k, t, "s") for k, t in enumerate(periodic_texts())] + [(3, "b b b b b b", "s"), (3, "b b b b b b", "s"), (None, "c " * 9, "s")]
    df = documents(spark, rows).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2)).withColumn("_id", F.lit(3))
    got = sorted([(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.word_runs(df.repartition(4)).collect()], key=str)
    want = []
    for i, t, _ in rows:
        w = re.findall(SPACE, t or "")
        want.append((i, brute_runs(w), brute_collapsed(w, brute_runs(w))))
    assert got == sorted(want, key=str)
    assert runs.word_runs(df.where("false")).count() == 0


def brute_query(i, t):
    w = re.findall(SPACE, t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(brute_collapsed(w, found)))


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = periodic_texts()
    rows = [(k, texts[k % len(texts)] if k % 3 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200))), "s") for k in range(200)]
    rows += [(None, "a " * 20, "s"), (None, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = runs_query.op13_word_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([brute_query(i, t) for i, t, _ in rows], key=str)
