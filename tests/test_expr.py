import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlab.functions import expr as X
from matchlab.functions import labels as L

NAN = float("nan")


def _col(spark, values, typ="double"):
    if typ == "double":
        values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def _pd_cut(values, edges, labels, right, include_lowest=False):
    s = pd.Series([v if v is not None else NAN for v in values], dtype="float64")
    out = pd.cut(s, bins=list(edges), labels=list(labels), right=right, include_lowest=include_lowest)
    return [None if pd.isna(v) else str(v) for v in out]


EDGE_VALUES = [0.0, 0.2499999, 0.25, 0.5, 0.85, 1.0, 1.0000001, -0.1, None, NAN, 0.2, 0.4, 0.6, 0.8]


def test_jaccard_band_edges(spark):
    got = [r[0] for r in _col(spark, EDGE_VALUES).select(X.jaccard_band("x")).collect()]
    exp = []
    for v in EDGE_VALUES:
        if v is None or math.isnan(v):
            exp.append(None)
        elif 0 <= v < .25:
            exp.append("0-25%")
        elif .25 <= v < .5:
            exp.append("25-50%")
        elif .5 <= v < .85:
            exp.append("50-85%")
        elif .85 <= v <= 1.0:
            exp.append("85-100%")
        else:
            exp.append(None)
    assert got == exp


def test_risk_band_matches_pandas_cut(spark):
    got = [r[0] for r in _col(spark, EDGE_VALUES).select(X.risk_band("x")).collect()]
    assert got == _pd_cut(EDGE_VALUES, L.RISK_EDGES, L.RISK_LABELS, right=True, include_lowest=True)


def test_percent_band_matches_pandas_cut(spark):
    vals = [None if v is None else v * 100 for v in EDGE_VALUES] + [100.05, 100.1]
    got = [r[0] for r in _col(spark, vals).select(X.jaccard_pct_band("x")).collect()]
    assert got == _pd_cut(vals, L.JACCARD_PCT_EDGES, L.JACCARD_LABELS, right=False)


def test_open_band_matches_pandas_cut(spark):
    vals = [-1e9, -10, -9.99, -1, 0, 1, 1.0001, 10, 10.0001, 1e9, None]
    got = [r[0] for r in _col(spark, vals).select(X.discrepancy_band("x")).collect()]
    assert got == _pd_cut(vals, L.DISCREPANCY_EDGES, L.DISCREPANCY_LABELS, right=True)


def test_tolerance_class(spark):
    vals = [-10, -1, 1, 10, 10.0001, -10.0001, None]
    got = [r[0] for r in _col(spark, vals).select(X.tolerance_class("x")).collect()]
    assert got == [L.TOLERANCE_OK] * 4 + [L.TOLERANCE_OVER, L.TOLERANCE_UNDER, None]
    got2 = [r[0] for r in _col(spark, [None]).select(X.tolerance_class("x", null_as_else=True)).collect()]
    assert got2 == [L.TOLERANCE_UNDER]


def test_truthy_text(spark):
    vals = ["true", "TRUE", "1", "t", "false", "0", "", None]
    rows = _col(spark, vals, "string").select(X.truthy_flag("x"), X.truthy_label("x")).collect()
    assert [r[0] for r in rows] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert [r[1] for r in rows][:4] == ["Igual"] * 4 and rows[-1][1] == "Diferente"


def test_year_from_text(spark):
    vals = ["2020-01-02", "2020-01-02 10:00:00", "02/01/2020", "", None]
    got = [r[0] for r in _col(spark, vals, "string").select(X.year_from_text("x")).collect()]
    assert got[0] == 2020 and got[2] is None and got[3] is None and got[4] is None


def test_size_class_decimal_rounding(spark):
    vals = [4, 4.00004, 4.00005, 15, None]
    got = [r[0] for r in _col(spark, vals).select(X.size_class("x")).collect()]
    assert got == ["Pequeno", "Pequeno", "Médio", "Médio", "Grande"]


def test_threshold_label_null_and_nan_are_below(spark):
    got = [r[0] for r in _col(spark, [0.85, 0.8499, None, NAN]).select(X.threshold_label("x")).collect()]
    assert got == [">= 85%", "< 85%", "< 85%", "< 85%"]


def test_split_qualified_last_separator(spark):
    df = spark.createDataFrame([("a - b - SP",), ("Lavras",), ("x - MG",)], "p string")
    n, s = X.split_qualified(F.col("p"))
    assert [tuple(r) for r in df.select(n, s).collect()] == [("a - b", "SP"), ("Lavras", None), ("x", "MG")]


def test_capitalize_and_slug(spark):
    df = spark.createDataFrame([("hELLO wORLD",), (" Centro-Oeste ",)], "s string")
    rows = df.select(X.capitalize("s"), X.slug("s")).collect()
    assert rows[0][0] == "Hello world"
    assert rows[1][1] == "centro_oeste"


def test_compact_number_matches_python_format(spark):
    vals = [999.0, 1000.0, 2500.0, 1_234_567.0, 999_999.0, 3_500.0]
    got = [r[0] for r in _col(spark, vals).select(X.compact_number("x")).collect()]

    def py(n):
        if n >= 1_000_000:
            return f"{n/1_000_000:.1f}M"
        if n >= 1_000:
            return f"{n/1_000:.1f}K"
        return f"{n:.0f}"
    assert got == [py(v) for v in vals]
    got0 = [r[0] for r in _col(spark, [2500.0, 3500.0]).select(X.compact_number("x", k_decimals=0, strict=True)).collect()]
    assert got0 == [f"{2500/1000:.0f}K", f"{3500/1000:.0f}K"]


def test_relative_diff_zero_divisor(spark):
    df = spark.createDataFrame([(10.0, 0.0), (11.0, 10.0)], "a double, b double")
    got = [r[0] for r in df.select(X.relative_diff_pct("a", "b")).collect()]
    assert got[0] is None and got[1] == pytest.approx(10.0)


def test_value_text_matches_python_formats(spark):
    vals = [5.0, 999.0, 1500.0, 2500.0, 999_999.0, 1_250_000.0, 12.5]

    def fmt(val, kind):
        if kind == "percent":
            return f"{val:.0f}%"
        pre = "R$" if kind == "currency" else ""
        if val >= 1_000_000:
            return f"{pre}{val/1_000_000:.1f}M"
        if val >= 1_000:
            return f"{pre}{val/1_000:.0f}K"
        return f"{pre}{val:.0f}"
    df = _col(spark, vals)
    for kind in ("percent", "currency", "number"):
        got = [r[0] for r in df.select(X.value_text("x", kind)).collect()]
        assert got == [fmt(v, kind) for v in vals], kind
    got = [r[0] for r in df.select(X.grouped_number("x", 0, "R$")).collect()]
    assert got == [f"R${v:,.0f}" for v in vals]


def test_title_case_and_codes_match_python(spark):
    vals = ["centro_oeste", "MIDDLE EAST", "4-NOT SPECIFIED", "they're here", "a", "", "x1y"]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x string")
    rows = df.select(X.title_case("x"), X.state_code("x"), X.code2("x")).collect()
    assert [r[0] for r in rows] == [v.title() for v in vals] + [None]
    assert [r[1] for r in rows][:len(vals)] == [v.split(" ")[0] if " " in v else v[:2] for v in vals]
    assert [r[2] for r in rows][:len(vals)] == [v[:2].upper() for v in vals]
    m = {"centro_oeste": "Centro-Oeste"}
    got = [r[0] for r in df.select(X.display_name("x", m)).collect()][:2]
    assert got == ["Centro-Oeste", "Middle East"]
