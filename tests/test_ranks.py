import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlab.operators import ranks


def _frame(spark, n=3000, seed=7, ties=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    if ties:
        v = np.round(v, 1)
    g = rng.choice(["a", "b", "c"], size=n, p=[.6, .3, .1])
    pdf = pd.DataFrame({"g": g, "v": v})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_ranks_match_pandas(spark, by):
    df, pdf = _frame(spark)
    got = ranks.average_ranks(df, "v", by).toPandas().set_index([*by, "v"])["rank"]
    values = pdf.groupby(by)["v"] if by else pdf["v"]
    exp = pdf.assign(r=values.rank(method="average")).groupby([*by, "v"])["r"].first()
    assert np.allclose(got.sort_index().values, exp.sort_index().values)


def jobs_started(spark, build):
    """What ``build`` returns, and whether a Spark job ran for it."""
    tracker, group = spark.sparkContext.statusTracker(), f"build-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_median_ranks_a_handful(spark):
    """No exchange carries rows, and passes whose targets are found are dropped with their scans."""
    df = spark.range(60_000).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"),
                                    F.when(F.col("id") % 5 < 3, 7.0).otherwise(F.rand(3) * 20).alias("v"))
    q, jobs = jobs_started(spark, lambda: ranks.exact_quantiles(df, "v", [0.5], ["g"]))
    assert jobs == 0
    assert {r.value_q for r in q.collect()} == {7.0}
    import re
    plan = str(q._jdf.queryExecution().executedPlan())
    final = plan[:plan.index("== Initial Plan ==")]
    rows = [int(x.replace(",", "")) for x in re.findall(r"records read: ([\d,]+)", final)]
    assert all(x < 6000 for x in rows)
    assert final.count("Range (0, 60000") <= 2 < plan.count("Range (0, 60000")


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles_match_numpy(spark, ties, wide, by):
    df, pdf = _frame(spark, ties=ties)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ranks.exact_quantiles(df, "v", qs, by, wide).collect()
    assert len(got) == len(qs) * (3 if by else 1)
    for r in got:
        assert r["value_q"] == pytest.approx(np.percentile(pdf.loc[pdf.g == r["g"], "v"] if by else pdf["v"], r["q"] * 100))


EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0,
            1.9999999999999998, 8.0, 7.999999999999999, 2.0 ** 1023, 1.7976931348623157e308, float("inf"), float("-inf"), -1.5, 1e-300, 1e300, 3.0, 0.1]


def test_order_key_is_the_bits_of_a_double(spark):
    rng = np.random.default_rng(4)
    values = np.array(EXTREMES + [2.0 ** k for k in range(-1074, 1024, 7)] + list(rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)))
    values = np.concatenate([values, np.nextafter(values[np.isfinite(values)], np.inf), np.nextafter(values[np.isfinite(values)], -np.inf)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ranks.with_order_key(df, "v", "k").select("v", "k", ranks.key_value(F.col("k")).alias("back")).collect()
    for v, k, back in got:
        bits = int(np.abs(np.float64(v)).view(np.int64))
        assert k == (-bits if v < 0 else bits) and back == v, v


def test_quantiles_of_clumps_within_clumps(spark):
    """Values that share their first 16, 32 or 48 bits with one another and an outlier beside."""
    rng = np.random.default_rng(1)
    values = np.concatenate([1 + rng.integers(0, 1 << 14, 700) * 2.0 ** -52, 1 + rng.integers(0, 1 << 10, 300) * 2.0 ** -36,
                             [1.06, 1.05, -1e300, 1e305], 1 + rng.integers(0, 9, 50) * 2.0 ** -20])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    qs = [0.0, 0.1, 0.3, 0.5, 0.61, 0.7, 0.9, 0.99, 1.0]
    for r in ranks.exact_quantiles(df, "v", qs).collect():
        assert r["value_q"] == pytest.approx(np.quantile(np.sort(values), r["q"]), rel=0, abs=1e-18), r


def test_quantiles_of_one_row_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 3.5), ("b", None), (None, 1.0), ("c", float("nan")), ("d", 1.0), ("d", 2.0)], "g string, v double")
    got = {r["g"]: r["value_q"] for r in ranks.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": 3.5, "d": 1.5}
    assert ranks.exact_quantiles(df.where("false"), "v", [0.5]).count() == 0


def test_few_checks_its_rows(spark):
    from matchlab.operators.joins import few
    small = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(few(small, 10).collect()) == sorted(small.collect())
    with pytest.raises(Exception, match="more than 9 rows"):
        few(small, 9).collect()


def test_exact_median_global_with_ties(spark):
    df, pdf = _frame(spark)
    got = ranks.exact_median(df, "v").collect()[0][0]
    assert got == pytest.approx(float(np.median(pdf["v"])))


def test_all_equal_values(spark):
    df = spark.createDataFrame([(1.0,)] * 10, "v double")
    r = ranks.average_ranks(df, "v").collect()
    assert r[0]["rank"] == pytest.approx(5.5) and r[0]["cnt"] == 10


def test_exact_quantiles_hot_value(spark):
    # one value holds a third of the rows
    vals = [5.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r["q"]: r["value_q"] for r in ranks.exact_quantiles(df, "v", [0.2, 0.5, 0.9]).collect()}
    for q, val in got.items():
        assert val == pytest.approx(np.percentile(vals, q * 100))
