import math

import numpy as np
import pandas as pd
import pytest

from matchlab.operators import ranktests as RT


def _brute_kw(pdf):
    r = pdf["v"].rank(method="average")
    n = len(pdf)
    groups = pdf["g"].unique()
    h = 12.0 / (n * (n + 1)) * sum(r[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in groups) - 3 * (n + 1)
    t = pdf["v"].value_counts().values.astype(float)
    return h / (1 - (t ** 3 - t).sum() / (n ** 3 - n)), len(groups)


def _brute_mw(x, y):
    both = pd.Series(np.concatenate([x, y]))
    r = both.rank(method="average").values
    n1, n2 = len(x), len(y)
    u1 = r[:n1].sum() - n1 * (n1 + 1) / 2
    t = both.value_counts().values.astype(float)
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (abs(u1 - n1 * n2 / 2) - 0.5) / sigma
    return u1, math.erfc(z / math.sqrt(2))


def _frame(spark, seed=3, n=2000):
    rng = np.random.default_rng(seed)
    g = rng.choice(["p", "q", "r"], size=n)
    v = np.round(rng.gamma(2.0, 1.0, size=n) + (g == "q") * 0.3, 1)
    pdf = pd.DataFrame({"g": g, "v": v})
    return spark.createDataFrame(pdf), pdf


def test_kruskal_matches_brute_force(spark):
    df, pdf = _frame(spark)
    row = RT.kruskal_test(df, "g", "v").collect()[0]
    h, k = _brute_kw(pdf)
    assert row["h"] == pytest.approx(h, rel=1e-9)
    assert row["dof"] == k - 1
    # chi-square with 2 degrees of freedom: survival = exp(-x / 2)
    assert row["p_value"] == pytest.approx(math.exp(-h / 2), rel=1e-9)
    assert row["epsilon2"] == pytest.approx(max(0, (h - k + 1) / (len(pdf) - k)))


def test_tail_probabilities(spark):
    from pyspark.sql import functions as F

    from matchlab.functions import stats
    rows = [(x, d) for x in [0.0, 0.01, 0.5, 3.0, 12.0, 90.0] for d in [1, 2, 3, 4, 7, 40]]
    df = spark.createDataFrame(rows, "x double, d int").select("x", "d", stats.chi2_sf(F.col("x"), F.col("d")).alias("p"))
    for x, d, p in df.collect():
        # even: finite sum; odd: recurrence from erfc
        if d % 2 == 0:
            want = sum(math.exp(-x / 2) * (x / 2) ** j / math.factorial(j) for j in range(d // 2))
        else:
            want = math.erfc(math.sqrt(x / 2)) + sum(
                math.exp(-x / 2) * (x / 2) ** (j + 0.5) / math.gamma(j + 1.5) for j in range(d // 2))
        assert p == pytest.approx(want, rel=1e-10), (x, d)
    z = spark.createDataFrame([(k / 10,) for k in range(0, 90)], "z double")
    for v, p in z.select("z", stats.normal_two_sided(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(v / math.sqrt(2)), rel=1e-10)


def test_mann_whitney_at_its_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    for correction, alpha in (("bonferroni", 0.05), ("sidak", 0.05), ("none", 0.05)):
        r = RT.mann_whitney_tests(df, "g", "v", correction=correction).first()
        assert r.u == 2.0 and r.p_value == pytest.approx(1.0) and r.alpha_corrigido == pytest.approx(alpha)
        assert r.n_significativos == 0 and not r.significativo


def test_mann_whitney_matches_brute_force(spark):
    df, pdf = _frame(spark)
    rows = {(r["grupo_1"], r["grupo_2"]): r for r in RT.mann_whitney_tests(df, "g", "v").collect()}
    assert set(rows) == {("p", "q"), ("p", "r"), ("q", "r")}
    for (a, b), r in rows.items():
        u, p = _brute_mw(pdf.v[pdf.g == a].values, pdf.v[pdf.g == b].values)
        assert r["u"] == pytest.approx(u)
        assert r["p_value"] == pytest.approx(p, rel=1e-9)
        assert r["u"] + (r["n1"] * r["n2"] - r["u"]) == r["n1"] * r["n2"]
        assert r["r_effect"] == pytest.approx(1 - 2 * u / (r["n1"] * r["n2"]))
        d = np.median(pdf.v[pdf.g == a]) - np.median(pdf.v[pdf.g == b])
        assert r["delta_mediana"] == pytest.approx(d)
        assert r["alpha_corrigido"] == pytest.approx(0.05 / 3)


def test_disjoint_groups_and_single_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", float(i + 10)) for i in range(4)],
                               "g string, v double")
    r = RT.mann_whitney_pairs(df, "g", "v").collect()[0]
    assert r["u"] == 0.0 and r["r_effect"] == 1.0
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert RT.kruskal_wallis(one, "g", "v").count() == 0
    assert RT.mann_whitney_pairs(one, "g", "v").count() == 0


def test_group_of_size_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("b", 0.5)], "g string, v double")
    r = RT.mann_whitney_pairs(df, "g", "v").collect()[0]
    u, _ = _brute_mw(np.array([1.0]), np.array([2.0, 3.0, 0.5]))
    assert r["u"] == pytest.approx(u)


def exact_distribution(m, n):
    """Arrangements of m among m + n ranks by their U, listed one by one."""
    from collections import Counter
    from itertools import combinations
    return Counter(sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m))


def test_exact_p_of_every_arrangement(spark):
    from pyspark.sql import functions as F

    from matchlab.functions import stats
    sizes = [(1, 1), (1, 5), (2, 2), (3, 3), (3, 8), (5, 4), (8, 8), (8, 3), (6, 11), (1, 40)]
    dist = {s: exact_distribution(*s) for s in sizes}
    rows = [(float(u), m, n) for m, n in sizes for u in range(m * n + 1)]
    df = spark.createDataFrame(rows, "u double, n1 long, n2 long")
    for u, m, n, p in df.select("*", stats.rank_sum_two_sided(F.col("u"), F.col("n1"), F.col("n2"))).collect():
        d = dist[m, n]
        want = min(1.0, 2 * sum(c for x, c in d.items() if x <= min(u, m * n - u)) / sum(d.values()))
        assert p == pytest.approx(want, rel=1e-12), (u, m, n)
    wide = spark.createDataFrame([(1900.0, 8, 500), (0.0, 2, 3000)], "u double, n1 long, n2 long") \
        .select(stats.rank_sum_two_sided(F.col("u"), F.col("n1"), F.col("n2")).alias("p")).collect()
    assert wide[0].p == pytest.approx(0.81, abs=0.02) and wide[1].p == pytest.approx(2 / math.comb(3002, 2), rel=1e-12)


def test_small_samples_get_exact_p(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (4.0, 5.0, 6.0)] + [("c", x) for x in (1.0, 9.0, 10.0)]
    got = {(r.grupo_1, r.grupo_2): r for r in RT.mann_whitney_tests(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["a", "b"].p_value == pytest.approx(0.1) and got["b", "c"].p_value == pytest.approx(0.7)
    assert got["a", "c"].ties > 0  # a tie: normal form
    u, p = _brute_mw(np.array([1.0, 2, 3]), np.array([1.0, 9, 10]))
    assert got["a", "c"].u == u and got["a", "c"].p_value == pytest.approx(p)


@pytest.mark.parametrize("block,rows", [(512, 1 << 16), (2, 40)])
def test_pairs_in_ranges_and_blocks(spark, monkeypatch, block, rows):
    """Many small ranges and blocks give what one of each gives; disjoint groups included."""
    monkeypatch.setattr(RT, "BLOCK_GROUPS", block)
    monkeypatch.setattr(RT, "RANGE_ROWS", rows)
    rng = np.random.default_rng(6)
    g = rng.choice(list("abcde"), size=900, p=[.4, .3, .2, .06, .04])
    v = np.round(rng.normal(size=900), 2) + np.where(g == "e", 50, 0)
    pdf = pd.DataFrame({"g": g, "v": v})
    got = {(r.grupo_1, r.grupo_2): r for r in RT.mann_whitney_pairs(spark.createDataFrame(pdf), "g", "v").collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        x, y = pdf.v[pdf.g == a].values, pdf.v[pdf.g == b].values
        u, _ = _brute_mw(x, y)
        t = pd.Series(np.concatenate([x, y])).value_counts().values.astype(float)
        assert r.u == pytest.approx(u) and r.ties == pytest.approx((t ** 3 - t).sum()) and (r.n1, r.n2) == (len(x), len(y))
        assert r.delta_mediana == pytest.approx(np.median(x) - np.median(y))


def test_two_thousand_groups(spark):
    """The plan doesn't grow with the groups, and each pair is there once."""
    from pyspark.sql import functions as F
    size = {}
    for k in (20, 2000):
        df = spark.range(4 * k).select((F.col("id") % k).cast("string").alias("g"), F.hash("id").cast("double").alias("v"))
        t = RT.mann_whitney_pairs(df, "g", "v")
        size[k] = len(t._jdf.queryExecution().optimizedPlan().toString())
        assert t.agg(F.count("*"), F.countDistinct("grupo_1", "grupo_2")).first()[:] == (k * (k - 1) // 2,) * 2
    assert size[2000] < 1.1 * size[20]
    assert t.where("grupo_1 < grupo_2 AND u BETWEEN 0 AND 16").count() == 1999000
