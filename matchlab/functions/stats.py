"""Tail probabilities as Column expressions (for the few result rows of a test)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 120


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 (about 1e-14 relative): the power series
    of erf below 2, its continued fraction from there on."""
    x = x.cast("double")
    one = lambda v: F.lit(float(v))
    start = F.struct(x.alias("term"), x.alias("total"))
    # erf(x) = 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (1 3 5 ... (2n+1)): positive terms only
    series = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, lambda a, n: F.struct(
        (a["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
        (a["total"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("total")))["total"]
    small = one(1) - one(2 / math.sqrt(math.pi)) * F.exp(-x * x) * series
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
    tail = F.aggregate(F.sequence(F.lit(_STEPS), F.lit(1)), x, lambda a, n: x + n / one(2) / a)
    large = F.exp(-x * x) / one(math.sqrt(math.pi)) / tail
    return F.when(x < 2, small).when(x >= 2, large)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= z) of the standard normal distribution, z >= 0."""
    return erfc(z / F.lit(math.sqrt(2.0)))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(X >= x) of the chi-square distribution with ``dof`` >= 1 degrees of freedom: finite
    sums of exp(-x/2) (x/2)^j / gamma(j + 1), over whole j (even dof) or half ones (odd
    dof, plus erfc). NULL for a NULL x; 1 for x <= 0. Terms beyond exp's range are kept
    in logarithms of running products, as ``dof`` is one less than the number of groups."""
    half = x.cast("double") / 2
    odd = dof % 2 == 1
    terms = F.floor(dof / 2).cast("int")
    # first term of either sum, then each next one by a factor half / j
    first = F.when(odd, F.log(F.sqrt(half) * 2 / F.lit(math.sqrt(math.pi)))).otherwise(F.lit(0.0))
    start = F.struct(first.alias("log"), F.lit(0.0).alias("total"))
    step = lambda a, j: F.struct(
        (a["log"] + F.log(half) - F.log(F.when(odd, j + 0.5).otherwise(j.cast("double")))).alias("log"),
        (a["total"] + F.exp(a["log"] - half)).alias("total"))
    body = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step)["total"]).otherwise(F.lit(0.0))
    p = body + F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0))
    return F.when(x <= 0, F.lit(1.0)).when((x > 0) & (dof > 0), F.least(p, F.lit(1.0)))


def rank_sum_two_sided(u: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p-value of a Mann-Whitney U (either sample's) without ties: twice the
    share of arrangements with the smaller U or less, 1 at most.

    The number of arrangements by U has the generating function of the products
    (1 - q^(n + i)) / (1 - q^i), i = 1..m, with m the smaller sample. It is kept as an array of the
    coefficients up to the observed U. A factor is a shifted copy taken off or added:
    1 / (1 - q^i) is the product of (1 + q^i), (1 + q^2i), (1 + q^4i), ..."""
    m, n = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    least = F.least(u, n1 * n2 - u).cast("int")
    size = least + 1
    doubled = lambda i: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(30)), lambda t: F.call_function("shiftleft", i.cast("long"), t)), lambda s: s < size)
    shifts = F.flatten(F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.array(-(n + i).cast("long")), doubled(i))))
    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), least))

    def factor(a: Column, s: Column) -> Column:
        by = F.least(F.abs(s), size.cast("long")).cast("int")
        moved = F.concat(F.array_repeat(F.lit(0.0), by), F.slice(a, F.lit(1), size - by))
        return F.zip_with(a, moved, lambda x, y: F.when(s < 0, x - y).otherwise(x + y))

    below = F.aggregate(F.aggregate(shifts, one, factor), F.lit(0.0), lambda t, x: t + x)
    ways = F.aggregate(F.sequence(F.lit(1), m), F.lit(1.0), lambda t, i: t * (n + i) / i)
    return F.least(F.lit(1.0), 2 * below / ways)
