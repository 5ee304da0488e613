"""Invariants on the registered queries (sf0.001) and published worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from matchlab.operators import ranktests as RT

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def Q():
    import __spark_entry__ as E
    return E.queries()


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_shares_sum_to_100(spark, Q):
    assert sum(r["pct"] for r in _rows(Q["freq_share"](spark, SF))) == pytest.approx(100, abs=1e-3)
    by_row = {}
    for r in _rows(Q["crosstab_row_pct"](spark, SF)):
        by_row[r["label_cpf"]] = by_row.get(r["label_cpf"], 0) + r["pct"]
    assert all(v == pytest.approx(100, abs=1e-3) for v in by_row.values())
    tot = {}
    for r in _rows(Q["stacked_shares"](spark, SF)):
        tot[(r["pair"], r["y"])] = tot.get((r["pair"], r["y"]), 0) + r["pct"]
    assert all(v == pytest.approx(100, abs=1e-3) for v in tot.values())


def test_margins_equal_cells_and_total_equals_count(spark, Q):
    rows = _rows(Q["crosstab_margins"](spark, SF))
    cells = [r for r in rows if r["level"] == "cell"]
    grand = [r for r in rows if r["level"] == "grand_total"][0]["n"]
    assert sum(r["n"] for r in cells) == grand
    for r in rows:
        if r["level"] == "row_total":
            assert r["n"] == sum(c["n"] for c in cells if c["label_cpf"] == r["label_cpf"])
    counts = Q["crosstab_counts"](spark, SF).agg(F.sum("n")).collect()[0][0]
    assert counts == grand


def test_u1_plus_u2_equals_n1n2(spark, Q):
    from matchlab.plans.common import M
    m = M(spark, SF)
    fwd = {(r["grupo_1"], r["grupo_2"]): r for r in _rows(RT.mann_whitney_pairs(m, "class_tam_imovel", "indice"))}
    groups = sorted({g for p in fwd for g in p})
    rev = _rows(RT.mann_whitney_pairs(m, "class_tam_imovel", "indice", groups=list(reversed(groups))))
    for r in rev:
        f = fwd[(r["grupo_2"], r["grupo_1"])]
        assert r["u"] + f["u"] == pytest.approx(f["n1"] * f["n2"])


def test_kde_mass_at_most_one(spark, Q):
    rows = sorted(_rows(Q["kde_by_group"](spark, SF)), key=lambda r: (r["class_tam_imovel"], r["j"]))
    for g in {r["class_tam_imovel"] for r in rows}:
        pts = [r for r in rows if r["class_tam_imovel"] == g]
        step = pts[1]["x"] - pts[0]["x"]
        assert sum(r["density"] for r in pts) * step <= 1.0 + 1e-3


def test_published_kruskal_examples(spark):
    # SciPy documentation examples of scipy.stats.kruskal
    df = spark.createDataFrame([("x", float(v)) for v in [1, 3, 5, 7, 9]] +
                               [("y", float(v)) for v in [2, 4, 6, 8, 10]], "g string, v double")
    r = RT.kruskal_test(df, "g", "v").collect()[0]
    assert r["h"] == pytest.approx(0.2727272727272734, rel=1e-9)
    assert r["p_value"] == pytest.approx(0.6015081344405895, rel=1e-9)
    df2 = spark.createDataFrame([("x", 1.0)] * 3 + [("y", 2.0)] * 3 + [("z", 2.0)] * 2, "g string, v double")
    r2 = RT.kruskal_test(df2, "g", "v").collect()[0]
    assert r2["h"] == pytest.approx(7.0, rel=1e-9)
    assert r2["p_value"] == pytest.approx(0.0301973834223185, rel=1e-9)


def test_published_mann_whitney_example(spark):
    # SciPy documentation example: U = 17, p = 0.11134688653314041 (asymptotic), 0.1111111111111111 (exact)
    males = [19, 22, 16, 29, 24]
    females = [20, 11, 17, 12]
    df = spark.createDataFrame([("a_m", float(v)) for v in males] + [("b_f", float(v)) for v in females],
                               "g string, v double")
    exact = RT.mann_whitney_tests(df, "g", "v").collect()[0]
    assert exact["u"] == 17.0 and exact["p_value"] == pytest.approx(1 / 9, rel=1e-12)
    r = RT.mann_whitney_tests(df, "g", "v", method="asymptotic").collect()[0]
    assert r["u"] == 17.0
    assert r["p_value"] == pytest.approx(0.11134688653314041, rel=1e-9)
    z = (abs(17 - 10) - 0.5) / math.sqrt(5 * 4 * 10 / 12)
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
