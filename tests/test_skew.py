"""One key / value holding a third of all rows: results stay whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlab.operators import aggregate as A
from matchlab.operators import ranks
from matchlab.operators import ranktests as RT
from matchlab.operators import topk as TK
from matchlab.operators import windows as WN


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 9000
    keys = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 500, size=n))
    vals = np.round(rng.normal(50, 10, size=n), 2)
    rows = [(int(k), float(v), f"g{int(k) % 3}") for k, v in zip(keys, vals)]
    return spark.createDataFrame(rows, "k long, v double, g string").repartition(8), rows


def test_best_row_hot_key(spark, skewed):
    df, rows = skewed
    got = {r["k"]: r["v"] for r in WN.best_per_key(df, "k", [F.col("v").desc()]).collect()}
    exp = {}
    for k, v, _ in rows:
        exp[k] = max(v, exp.get(k, -1e18))
    assert got == exp


def test_distinct_count_and_sizes_hot_key(spark, skewed):
    df, rows = skewed
    dc = {r["k"]: r["n_distinct"] for r in A.distinct_count(df, "v", ["k"]).collect()}
    assert dc[0] == len({v for k, v, _ in rows if k == 0})
    sz = {r["k"]: r["n"] for r in A.group_size(df, ["k"]).collect()}
    assert sz[0] == 3000 and sum(sz.values()) == len(rows)


def test_group_quantiles_hot_group(spark, skewed):
    df, rows = skewed
    got = {r["k"]: r["median"] for r in A.group_median(df, ["k"], "v").collect()}
    for k in (0, 7, 123):
        vs = [v for kk, v, _ in rows if kk == k]
        if vs:
            assert got[k] == pytest.approx(float(np.median(vs)))
    assert len(got) == len({k for k, _, _ in rows})


def test_ranks_with_hot_value(spark):
    vals = [1.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(v, "a" if i % 2 else "b") for i, v in enumerate(vals)], "v double, g string")
    r = {x["v"]: x["rank"] for x in ranks.average_ranks(df, "v").collect()}
    s = sorted(vals)
    first = s.index(1.0)
    last = len(s) - 1 - s[::-1].index(1.0)
    assert r[1.0] == pytest.approx((first + last) / 2 + 1)
    kw = RT.kruskal_wallis(df, "g", "v").collect()[0]
    assert kw["n"] == len(vals) and kw["k"] == 2


def test_top_k_hot_category(spark, skewed):
    df, rows = skewed
    top = [r["k"] for r in TK.top_k_counts(df, "k", 3).collect()]
    assert top[0] == 0
    rel = TK.top_k_or_other(df, "k", 3, -1)
    assert rel.count() == len(rows)


@pytest.mark.parametrize("hot_rows", [50, 10 ** 6])
def test_best_match_over_a_hot_owner(spark, hot_rows):
    """The n:m bridge with one owner holding a third of it, against nested loops."""
    from matchlab.operators import joins as J
    rng = np.random.default_rng(5)
    matches = [(int(k), int(p), None if i > 8 else float(i), int(n)) for n, (k, p, i) in enumerate(
        zip(rng.integers(0, 120, 600), rng.integers(0, 40, 600), rng.integers(0, 10, 600)))]
    bridge = sorted({(int(k), int(o)) for k, o in zip(rng.integers(0, 110, 200), rng.integers(1, 60, 200))} | {(k, 0) for k in range(100)})
    bridge += [(5, None), (None, 3)]
    owners = [(o, None if o % 10 == 9 else o % 6) for o in range(50)]
    parcels = [(p, p % 7 if p % 8 else None) for p in range(35)]
    got = J.best_match_by_owner(
        spark.createDataFrame(matches, "k long, p long, i double, n long"), spark.createDataFrame(bridge, "k long, owner long"),
        spark.createDataFrame(owners, "owner long, owner_code long"), spark.createDataFrame(parcels, "p long, parcel_code long"),
        "k", "p", "i", ["p", "n"], hot_rows).collect()
    codes, of = dict(parcels), dict(owners)
    rows = {}
    for k, p, i, n in matches:
        for b, o in bridge:
            if b == k and o in of and p in codes:
                same = of[o] is not None and of[o] == codes[p]
                rows.setdefault(k, []).append((i is not None, -(i or 0), not same, p, n))
    want = {(k, -r[1] if r[0] else None, not r[2], r[3], r[4]) for k, r in ((k, min(v)) for k, v in rows.items())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block,wide", [(20, False), (20, True), (10 ** 6, False)])
def test_near_pairs_of_a_dense_cell(spark, block, wide):
    """Half of all points in one cell, some of them in one place: same pairs, bounded blocks."""
    from matchlab.operators import joins as J
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.random((300, 2)), np.full((60, 2), 0.37), rng.random((360, 2)) * 24 - 12, [[1.0, 1.0], [0.0, 1.0], [1.0, 0.5], [2.0, 1.0]]])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)] + [(-1, None, 0.5)], "id long, x double, y double")
    got = {(r.id_1, r.id_2) for r in J.pairs_within(df, "id", "x", "y", 1.0, block=block, wide=wide).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    assert got == {(i, j) for i, j in zip(*np.nonzero(d < 1.0)) if i < j}
    if block == 20:
        for side in J.near_blocks(df, "id", "x", "y", 1.0, block=block, wide=wide):
            assert side.groupBy(J._KEY).count().agg(F.max("count")).first()[0] <= 5 * block
