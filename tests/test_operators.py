import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlab.functions import labels as L
from matchlab.operators import aggregate as A
from matchlab.operators import distribution as D
from matchlab.operators import filters as FL
from matchlab.operators import joins as J
from matchlab.operators import topk as TK
from matchlab.operators import windows as WN


def test_best_per_key_tie_breakers(spark):
    rows = [(1, 0.9, False, 5), (1, 0.9, True, 7), (1, None, True, 1), (2, None, True, 3), (2, 0.1, False, 9),
            (3, 0.5, True, 2), (3, 0.5, True, 1)]
    df = spark.createDataFrame(rows, "k long, idx double, eq boolean, nb long")
    order = [F.col("idx").desc_nulls_last(), WN.owner_first("eq"), F.col("nb")]
    got = {r["k"]: (r["idx"], r["eq"], r["nb"]) for r in WN.best_per_key(df, "k", order).collect()}
    assert got == {1: (0.9, True, 7), 2: (0.1, False, 9), 3: (0.5, True, 1)}
    nf = [F.col("idx").desc_nulls_first(), WN.owner_first("eq"), F.col("nb")]
    got2 = {r["k"]: r["nb"] for r in WN.best_per_key(df, "k", nf).collect()}
    assert got2[1] == 1 and got2[2] == 3


def test_filter_spec_precedence_and_places(spark):
    df = spark.createDataFrame([("N", "SP", "Lavras"), ("N", "MG", "Lavras"), ("S", "RS", "a - b")],
                               "regiao string, estado string, municipio_nome string")
    spec = FL.FilterSpec.of(regions=["S"], states=["SP"], places=["Lavras - MG", " a - b - RS "])
    r = spec.resolved()
    assert r.regions == () and r.states == ()
    got = sorted(tuple(x) for x in r.apply(df).collect())
    assert got == [("N", "MG", "Lavras"), ("S", "RS", "a - b")]
    assert FL.FilterSpec.of(regions=["", None]).apply(df).count() == 3


def test_complete_groups_and_guard(spark):
    mem = spark.createDataFrame([("n", "AC"), ("n", "AM"), ("s", "PR"), ("s", "RS")], "regiao string, estado string")
    sel = spark.createDataFrame([("AC",), ("AM",), ("PR",)], "estado string")
    assert [r[0] for r in FL.complete_groups(mem, sel, "regiao", "estado").collect()] == ["n"]
    assert FL.guard_min_rows(mem, 5).count() == 0
    assert FL.guard_min_rows(mem, 4).count() == 4


def test_pairs_within_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, size=(120, 2)))]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r["id_1"], r["id_2"]) for r in J.pairs_within(df, "id", "x", "y", 1.5).collect()}
    exp = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2)
           if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 1.5 ** 2}
    assert got == exp


def test_top_k_or_other(spark):
    rows = [(c,) for c, n in zip("abcdef", [5, 4, 4, 3, 1, 1]) for _ in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "p string")
    got = {r["p"]: r["n"] for r in TK.top_k_or_other(df, "p", 3, "Outros").groupBy("p")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 5, "b": 4, "c": 4, "Outros": 6}
    same = TK.top_k_or_other(df, "p", 10, "Outros")
    assert same.filter(F.col("p").isNull()).count() == 1


def test_complete_domain_and_margins(spark):
    df = spark.createDataFrame([("Igual", "0-25%")] * 3 + [("Diferente", "85-100%")] * 2, "label_cpf string, faixa string")
    c = A.crosstab_counts(df, "label_cpf", "faixa")
    full = J.complete_domain(c, {"label_cpf": L.OWNER_LABELS, "faixa": L.JACCARD_LABELS}, {"n": 0})
    assert full.count() == 8 and full.agg(F.sum("n")).collect()[0][0] == 5
    m = {(r["label_cpf"], r["faixa"]): r["n"] for r in A.crosstab_margins(df, "label_cpf", "faixa").collect()}
    assert m[("__all__", "__all__")] == 5 and m[("Igual", "__all__")] == 3


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10]], "x double")
    h = {r["bin"]: r["n"] for r in D.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}
    np_counts, _ = np.histogram([0, 1, 2, 10], bins=5)
    assert [h[i] for i in range(5)] == list(np_counts)


def test_kde_direct_and_normalised(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(40, 8, 3000), rng.normal(70, 5, 1000)])
    df = spark.createDataFrame([("a", float(v)) for v in vals], "g string, x double")
    direct = D.kde(df, "x", ["g"], grid_size=60).toPandas().sort_values("j")
    sd, n = vals.std(ddof=1), len(vals)
    h = sd * n ** -0.2
    x0 = direct.x.values[7]
    exact = np.exp(-0.5 * ((x0 - vals) / h) ** 2).sum() / (n * h * math.sqrt(2 * math.pi))
    assert direct.density.values[7] == pytest.approx(exact, rel=1e-9)
    step = direct.x.values[1] - direct.x.values[0]
    assert (direct.density.values * step).sum() <= 1.0 + 1e-6


def test_box_summary_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(0, 1, 500), [8.0, -9.0]])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "k string, x double")
    r = D.box_summary(df, "x", ["k"]).collect()[0]
    q1, q3 = np.percentile(vals, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = vals[(vals >= lo) & (vals <= hi)]
    assert r["q1"] == pytest.approx(q1) and r["q3"] == pytest.approx(q3)
    assert r["whisker_lo"] == pytest.approx(inside.min()) and r["n_outliers"] == int(((vals < lo) | (vals > hi)).sum())


def test_linear_trend_matches_polyfit(spark):
    ys = [3.0, 2.5, 4.0, 4.5, 6.0]
    df = spark.createDataFrame([(2000 + i, y) for i, y in enumerate(ys)], "ano int, y double")
    r = D.linear_trend(df, "ano", "y").collect()[0]
    slope, intercept = np.polyfit(np.arange(len(ys)), ys, 1)
    assert r["slope"] == pytest.approx(slope) and r["intercept"] == pytest.approx(intercept)


def test_minmax_rescale_constant(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5)], "k string, n long")
    assert {r["size"] for r in A.minmax_rescale(df, "n").collect()} == {100.0}


def test_kpi_row_empty_input(spark):
    df = spark.createDataFrame([], "indice double, estado string, area_a double, cpf_ok int")
    r = A.kpi_row(df).collect()[0]
    assert tuple(r) == (0, 0.0, 0.0, 0, 0.0, 0.0)


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1, 20.0), (2, 30.0), (3, 50.0)], "o int, s double")
    got = [(r["offset"], r["centre"]) for r in WN.cumulative_share(df, "o", "s", gap=1.0).orderBy("o").collect()]
    assert got == [(0.0, 10.0), (21.0, 36.0), (52.0, 77.0)]


def test_place_filter_from_table_and_large_isin(spark):
    df = spark.createDataFrame([("Lavras", "MG"), ("Lavras", "SP"), ("a - b", "RS"), ("Ouro", "MG")],
                               "municipio_nome string, estado string")
    sel = spark.createDataFrame([("Lavras - SP",), ("a - b - RS",), ("Ouro",)], "place string")
    got = sorted(tuple(r) for r in FL.place_filter_from_table(df, sel).collect())
    assert got == [("Lavras", "SP"), ("Ouro", "MG"), ("a - b", "RS")]
    many = [f"x{i}" for i in range(2000)] + ["MG"]
    assert FL.isin_or_semijoin(df, "estado", many).count() == 2
    assert FL.isin_or_semijoin(df, "estado", ["SP", " "]).count() == 1


def test_union_parts_raises_unless_optional(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from matchlab.sources import files as S
    bad = lambda: spark.read.parquet(str(tmp_path / "nope"))
    with pytest.raises(AnalysisException):
        S.union_parts({"a": bad}, "part")
    assert S.union_parts({"a": bad}, "part", optional=["a"]) == (None, ["a"])


def test_qualified_places_intended_and_parity(spark):
    df = spark.createDataFrame([("A", "SP"), ("A", "MG"), ("B", "SP"), ("B", "SP"), ("C", "RS")],
                               "municipio_nome string, estado string")
    got = sorted(r["place"] for r in WN.qualified_places(df, "municipio_nome", "estado").collect())
    assert got == ["A - MG", "A - SP", "B", "C"]
    quirk = sorted(r["place"] for r in WN.qualified_places(df, "municipio_nome", "estado", True).collect())
    assert quirk == ["A - MG", "A - SP", "B - SP", "C"]


def test_context_rows_branches(spark):
    rows = [("N", "AC", "P"), ("N", "AM", "P"), ("S", "PR", "G"), ("S", "SC", "P"), ("N", "AC", "G")]
    df = spark.createDataFrame(rows, "regiao string, estado string, class_tam_imovel string")
    # the dimension knows a state without rows: N is not complete without it
    dim = spark.createDataFrame([("N", "AC"), ("N", "AM"), ("S", "PR"), ("S", "SC"), ("S", "RS")], "regiao string, estado string")

    def got(**kw):
        return sorted(tuple(r) for r in FL.context_rows(df, FL.FilterSpec.of(**kw), dim).collect())
    assert got(states=["AC", "AM", "PR"], sizes=["P"]) == [("N", "AC", "P"), ("N", "AM", "P")]
    assert got(states=["PR", "SC"], sizes=["P"]) == [("N", "AC", "P"), ("N", "AM", "P"), ("S", "SC", "P")]  # none complete: all regions
    assert got(states=["AC"], regions=["S"]) == [("S", "PR", "G"), ("S", "SC", "P")]  # explicit regions alone
    assert got(states=["AC"], regions=["X"], sizes=["P"]) == [("N", "AC", "P")]  # nothing left: the filtered rows
    assert got(regions=["S"], sizes=["G"]) == [("S", "PR", "G")]


def test_selection_lists_and_tables_agree(spark):
    df = spark.createDataFrame([("SP",), ("MG",), (None,)], "estado string")
    table = lambda v: spark.createDataFrame([(x,) for x in v], "e string")
    for values, n in ((["SP", " ", None], 1), ([], 3), ([" "], 3), (["x"], 0)):
        assert FL.isin_or_semijoin(df, "estado", values).count() == n
        assert FL.isin_or_semijoin(df, "estado", table(values)).count() == n


def test_degenerate_inputs(spark):
    from matchlab.operators import classify as C
    from matchlab.operators import ranktests as RT
    none = spark.createDataFrame([], "label_cpf string, indice double, g string, v double, k int")
    r = C.reliability_matrix(none).collect()
    assert len(r) == 4 and all(x.n == 0 and x.pct == 0 for x in r)
    assert {(x.n, x.pct_col, x.col_share, x.row_share) for x in C.risk_matrix(none).collect()} == {(0, 0.0, 0.0, 0.0)}
    assert tuple(A.join_coverage(none, "k").first()) == (0, 0, 0.0)
    tied = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    t = RT.kruskal_test(tied, "g", "v").first()
    assert t.h is None and t.p_value is None and t.diferenca_global is None
    single = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    s = RT.kruskal_test(single, "g", "v").first()
    assert s.h == pytest.approx(1.0) and s.epsilon2 is None and s.magnitude is None
    assert RT.kruskal_test(tied.where("g = 'a'"), "g", "v").count() == 0


def test_nan_becomes_null_at_load(spark):
    from matchlab.operators.derive import derive_matches
    rows = [("true", "2020-01-02", float("nan"), 3, 10.0, 8.0, "X"), ("true", "2020-01-02", 0.5, 3, 10.0, 8.0, "X")]
    raw = spark.createDataFrame(rows, "igualdade_txt string, data_cadastro_imovel string, indice double, num_modulo int, "
                                      "area_a double, area_b double, estado string")
    k = A.kpi_row(derive_matches(raw)).first()
    assert k.avg_jaccard == pytest.approx(50.0) and k.median_jaccard == pytest.approx(50.0)


def test_registered_totals_grain_rule(spark):
    rows = [("N", "AC", "x", 1, 2020, 10, 100, "P"), ("N", "AC", "x", 1, 2020, 10, 100, "G"),
            ("N", "AC", "y", 2, 2020, 5, 100, "P"), ("S", "PR", "z", 3, 2021, 7, 40, "P")]
    df = spark.createDataFrame(rows, "regiao string, estado string, municipio_nome string, idt_municipio long, "
                                     "ano_cadastro int, total_cars_municipio long, total_cars_cadastrados long, "
                                     "class_tam_imovel string")
    by_place = {r["ano_cadastro"]: r["total_cars"] for r in
                A.registered_totals_by_year(df, FL.FilterSpec.of(places=["x", "y"], sizes=["G"])).collect()}
    assert by_place == {2020: 15}          # place grain, duplicates counted once, size filter ignored
    by_state = {r["ano_cadastro"]: r["total_cars"] for r in
                A.registered_totals_by_year(df, FL.FilterSpec.of(statuses=["A"])).collect()}
    assert by_state == {2020: 100, 2021: 40}


def test_match_rate_and_two_way(spark):
    ents = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "k long, g string")
    hits = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    r = {x["g"]: x["pct"] for x in A.match_rate(ents, "k", "g", hits, "pct").collect()}
    assert r == {"A": 50.0, "B": 100.0}
    other = spark.createDataFrame([("A", 80.0), ("C", 10.0)], "g string, pct2 double")
    both = {x["g"]: (x["pct"], x["pct2"]) for x in A.two_way_match(A.match_rate(ents, "k", "g", hits, "pct"),
                                                                   other, "g").collect()}
    assert both == {"A": (50.0, 80.0), "B": (100.0, None), "C": (None, 10.0)}


def test_kde_heavy_tail_is_direct(spark):
    vals = np.random.default_rng(9).lognormal(0, 2, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    d = D.kde(df, "x", [], grid_size=40).toPandas().sort_values("j")
    h = vals.std(ddof=1) * len(vals) ** -0.2
    want = [np.exp(-0.5 * ((x - vals) / h) ** 2).sum() / (len(vals) * h * math.sqrt(2 * math.pi)) for x in d.x]
    assert len(d) == 40 and np.allclose(d.density, want, rtol=1e-9, atol=1e-15)


def test_missing_columns_are_named(spark):
    from matchlab.operators.derive import derive_matches
    with pytest.raises(ValueError, match="missing columns: indice, num_modulo"):
        derive_matches(spark.createDataFrame([], "igualdade_txt string, data_cadastro_imovel string, area_a double, area_b double"))
