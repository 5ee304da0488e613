"""Distributed rank tests (K1-K4, W4): Kruskal-Wallis and pairwise Mann-Whitney.

No row is ranked individually and no group is sorted in one task; every
statistic is a sum over (group, value) counts, combined before the shuffle:

* average rank of value v = C_all(<v) + (c_all(v) + 1) / 2
* Kruskal-Wallis rank sums R_g = sum_v c_g(v) * rank(v), by joining the
  (group, value) counts to the pooled ranks;
* Mann-Whitney U(g1, g2) = sum_v c_g1(v) * (C_g2(<v) + c_g2(v) / 2) and the tie term
  sum_v (t^3 - t) of every pair, in long form: the counts are dealt out by ranges of
  values, each range carries the running counts of all groups before it, and groups
  are taken in blocks. A task has one range and two blocks; it adds products of counts
  and running counts to a matrix of the blocks' pairs. Neither the plan nor the driver
  holds anything of the number of groups.

p-values are Column expressions (``functions.stats``) on the result rows: exact for small
samples without ties, else normal. H is NULL where it isn't defined: all values tie, or
there is one row. Effect sizes without spare degrees of freedom (n = k) are NULL as well.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.stats import chi2_sf, normal_two_sided, rank_sum_two_sided
from ..sources import catalog
from . import ranks
from .joins import attach_one_row

#: (group, value) counts of a range, and groups of a block.
RANGE_ROWS, BLOCK_GROUPS = 1 << 16, 512
#: The smaller sample up to which U is compared with its exact distribution.
EXACT_SAMPLE = 8


def _clean(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.filter(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v.cast("double"))) \
        .select(F.col(group).cast("string").alias("_g"), v.cast("double").alias("_v"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """K1 + K2: H (tie corrected), dof, epsilon^2, eta^2, magnitude, N, k.

    Rank sums by join, so any number of groups works and nothing reaches the
    driver: (group, value) counts are joined to the pooled average rank of
    each value.  One row; empty when fewer than 2 groups."""
    d = _clean(df, group, value)
    vcg = d.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("c"))
    vc = vcg.groupBy("_v").agg(F.sum("c").alias("t"))
    rk = ranks.cumulative_before(vc, "_v", ["t"]).select(
        "_v", "t", (F.col("t_before") + (F.col("t") + 1) / 2.0).alias("rank"))
    rs = vcg.join(rk.select("_v", "rank"), "_v").groupBy("_g").agg(
        F.sum(F.col("c") * F.col("rank")).alias("R"), F.sum("c").cast("double").alias("n_g"))
    per = rs.agg(F.sum(F.col("R") * F.col("R") / F.col("n_g")).alias("S"), F.count(F.lit(1)).alias("k"),
                 F.sum("n_g").alias("N"))
    ties = vc.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("TT"))
    s = attach_one_row(per, ties)
    N, k = F.col("N"), F.col("k")
    spread = 1 - F.try_divide(F.col("TT"), N * N * N - N)
    h = F.try_divide(12.0 / (N * (N + 1)) * F.col("S") - 3 * (N + 1), spread)
    out = s.select(h.alias("h"), N, k)
    eps = F.try_divide(F.col("h") - k + 1, F.col("N") - k)
    eps = F.when(eps.isNotNull(), F.greatest(F.lit(0.0), eps))
    mag = (F.when(F.col("epsilon2") < L.EFFECT_CUTS[0], F.lit(L.EFFECT_LABELS[0]))
           .when(F.col("epsilon2") < L.EFFECT_CUTS[1], F.lit(L.EFFECT_LABELS[1]))
           .when(F.col("epsilon2") < L.EFFECT_CUTS[2], F.lit(L.EFFECT_LABELS[2]))
           .when(F.col("epsilon2").isNotNull(), F.lit(L.EFFECT_LABELS[3])))
    out = (out.withColumn("epsilon2", eps).withColumn("eta2", F.try_divide(F.col("h"), F.col("N") - 1))
           .withColumn("magnitude", mag)
           .select("h", (F.col("k") - 1).cast("long").alias("dof"), "epsilon2", "eta2", "magnitude",
                   F.col("N").cast("long").alias("n"), F.col("k").cast("long").alias("k")))
    return out.filter(F.col("k") >= 2)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Of one range and the blocks (a, b): for groups i of a and j of b, i < j, the sums over the
    range's values of c_i (C_j + c_j / 2) and of c_i c_j (c_i + c_j). Rows have the group, its block's
    ``side`` (0: a, 1: b; both if a = b), the value and its count; rows without a value carry
    the group's count before the range."""
    side, gid = table["side"].to_numpy(), table["gid"].to_numpy()
    count = table["c"].to_numpy().astype(float)
    head = np.asarray(table["_v"].is_null())
    # groups without rows here add nothing, but in the first range, whose heads count none
    left, right = np.unique(gid[(side == 0) & (~head | (count == 0))]), np.unique(gid[side == 1])
    values, v = np.unique(table["_v"].to_numpy()[~head], return_inverse=True)
    carried = np.zeros(len(right))
    at = head & (side == 1)
    carried[np.searchsorted(right, gid[at])] = count[at]
    u, x = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    s, g, c = side[~head], gid[~head], count[~head]
    order = np.argsort(v, kind="stable")
    s, g, c, v = s[order], g[order], c[order], v[order]
    step = max(1, (1 << 21) // max(1, len(right)))  # values whose counts are held at once
    for lo in range(0, len(values), step):
        i, j = np.searchsorted(v, [lo, lo + step])
        here = np.zeros((min(step, len(values) - lo), len(right)))
        r = s[i:j] == 1
        here[v[i:j][r] - lo, np.searchsorted(right, g[i:j][r])] = c[i:j][r]
        before = carried + np.cumsum(here, 0) - here / 2  # C_j + c_j / 2
        rows = np.flatnonzero(~r) + i
        rows = rows[np.argsort(g[rows], kind="stable")]
        for k in range(0, len(rows), 4096):
            part = rows[k:k + 4096]
            own, first = np.unique(g[part], return_index=True)
            to, w, at = np.searchsorted(left, own), c[part][:, None], v[part] - lo
            u[to] += np.add.reduceat(w * before[at], first)
            x[to] += np.add.reduceat(w * here[at] * (w + here[at]), first)
        carried = carried + here.sum(0)
    i, j = np.nonzero(left[:, None] < right[None, :])
    return pa.table({"g1": pa.array(left[i], pa.int32()), "g2": pa.array(right[j], pa.int32()),
                     "u": pa.array(u[i, j]), "x": pa.array(x[i, j])})


def mann_whitney_pairs(df: DataFrame, group: str, value: str, groups: Sequence[str] | None = None,
                       with_medians: bool = True) -> DataFrame:
    """K3 (J8 pairs g1 < g2): U of the first group, n1, n2, tie term, rank-biserial
    r = 1 - 2U/(n1 n2) and the median difference (of the middle values, as ranks find them
    in the running counts). Any number of groups; ``groups`` keeps some, in their order."""
    d = _clean(df, group, value)
    d = d if groups is None else d.where(F.col("_g").isin(list(groups)))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    vc = catalog.written(d.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("c")), "group-values")
    cube = F.col("c").cast("double")
    per = vc.groupBy("_g").agg(F.sum("c").alias("n"), F.sum(cube * cube * cube - cube).alias("t"))
    # the groups are numbered in the order of their labels, or of ``groups``: one row each
    order = [F.col("_g")] if groups is None else [F.array_position(F.array(*map(F.lit, groups)), F.col("_g"))]
    per = catalog.written(per.withColumn("gid", F.row_number().over(Window.orderBy(*order)) - 1), "groups")
    k = per.count()
    ranges = max(1, -(-vc.count() // max(RANGE_ROWS, 32 * k)))
    vc = vc.join(per.select("_g", "gid"), "_g").select("gid", "_v", "c")
    vc = catalog.written(vc.repartitionByRange(ranges, "_v").withColumn("part", F.spark_partition_id()), "value-ranges")

    # counts of every group before each range in which the group, or any of its pairs, has rows
    parts = vc.groupBy("part", "gid").agg(F.sum("c").alias("c"))
    before = Window.partitionBy("gid").orderBy("part")
    parts = parts.withColumn("upto", F.sum("c").over(before)) \
        .withColumn("next", F.coalesce(F.lead("part").over(before), F.lit(ranges)))
    since = F.explode(F.sequence(F.col("part") + 1, F.col("next"))).alias("part")
    carried = parts.select("gid", "upto", since).where(F.col("part") < ranges).select("part", "gid", F.col("upto").alias("c"))
    # the first range has a row of every group, so that it gives every pair
    first = per.select(F.lit(0).alias("part"), "gid", F.lit(0).cast("long").alias("c"))
    heads = carried.unionByName(first).withColumn("_v", F.lit(None).cast("double"))

    blocks = -(-k // BLOCK_GROUPS) if k else 0
    own = F.floor(F.col("gid") / BLOCK_GROUPS).cast("int")
    pairs = F.flatten(F.array(
        F.transform(F.sequence(own, F.lit(blocks - 1)), lambda b: F.struct(own.alias("a"), b.cast("int").alias("b"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0), own), lambda a: F.struct(a.cast("int").alias("a"), own.alias("b"), F.lit(1).alias("side")))))
    rows = vc.select("part", "gid", "_v", "c").unionByName(heads.select("part", "gid", "_v", "c"))
    rows = rows.select("part", "gid", "_v", "c", F.inline(pairs))
    sums = rows.groupBy("part", "a", "b").applyInArrow(_pair_sums, "g1 int, g2 int, u double, x double")
    sums = sums.groupBy("g1", "g2").agg(F.sum("u").alias("u"), F.sum("x").alias("x"))

    if with_medians:
        inside = Window.partitionBy("part", "gid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        at = vc.select("part", "gid", "_v", "c", F.coalesce(F.sum("c").over(inside), F.lit(0)).alias("_in"))
        at = at.join(carried.select("part", "gid", F.col("c").alias("_off")), ["part", "gid"], "left").join(per.select("gid", "n"), "gid")
        low = F.col("_in") + F.coalesce("_off", F.lit(0))
        pos = (F.col("n") - 1) / 2.0
        middle = [F.max(F.when((low <= p) & (p < low + F.col("c")), F.col("_v"))) for p in (F.floor(pos), F.ceil(pos))]
        per = per.join(at.groupBy("gid").agg(((middle[0] + middle[1]) / 2.0).alias("median")), "gid")
    one = per.select([F.col(c).alias(f"{c}_1") for c in per.columns])
    two = per.select([F.col(c).alias(f"{c}_2") for c in per.columns])
    out = sums.join(one, F.col("g1") == F.col("gid_1")).join(two, F.col("g2") == F.col("gid_2"))
    return out.select(
        F.col("_g_1").alias("grupo_1"), F.col("_g_2").alias("grupo_2"), "u", F.col("n_1").alias("n1"), F.col("n_2").alias("n2"),
        (F.col("t_1") + F.col("t_2") + 3 * F.col("x")).alias("ties"),
        *([(F.col("median_1") - F.col("median_2")).alias("delta_mediana")] if with_medians else []),
        (1 - 2 * F.col("u") / (F.col("n_1") * F.col("n_2"))).alias("r_effect"))


def kruskal_test(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """K1 with its p-value and the global decision."""
    kw = kruskal_wallis(df, group, value)
    return kw.withColumn("p_value", chi2_sf(F.col("h"), F.col("dof"))) \
        .withColumn("diferenca_global", F.col("p_value") < alpha)


def mann_whitney_tests(df: DataFrame, group: str, value: str, alpha: float = 0.05,
                       correction: str = "bonferroni", groups: Sequence[str] | None = None,
                       method: str = "auto") -> DataFrame:
    """K3 + K4: two-sided p, corrected alpha (bonferroni / sidak / none), significance and direction.

    p is exact where the smaller sample has at most EXACT_SAMPLE rows and the pair has no
    ties (``method`` auto); else, or with ``method`` asymptotic, it is the normal
    approximation, tie and continuity corrected."""
    if method not in ("auto", "asymptotic"):
        raise ValueError(f"method {method!r}: auto or asymptotic")
    mw = mann_whitney_pairs(df, group, value, groups)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    # within half a rank of the mean the corrected distance is none
    z = F.when(sigma > 0, F.greatest(F.lit(0.0), F.abs(F.col("u") - mu) - 0.5) / sigma)
    m = mw.agg(F.count(F.lit(1)).alias("_m"))
    small = (F.least("n1", "n2") <= (EXACT_SAMPLE if method == "auto" else 0)) & (F.col("ties") == 0)
    p = F.when(small, rank_sum_two_sided(F.col("u"), F.col("n1"), F.col("n2"))) \
        .when(sigma > 0, normal_two_sided(z)).otherwise(F.lit(1.0))
    out = attach_one_row(mw, m).withColumn("p_value", p)
    if correction == "bonferroni":
        a = F.lit(alpha) / F.col("_m")
    elif correction == "sidak":
        a = 1 - F.pow(F.lit(1 - alpha), 1 / F.col("_m"))
    elif correction == "none":
        a = F.lit(alpha)
    else:
        raise ValueError(f"correction {correction!r}: one of bonferroni, sidak, none")
    return (out.withColumn("alpha_corrigido", a)
            .withColumn("significativo", F.col("p_value") < F.col("alpha_corrigido"))
            .withColumn("n_significativos", F.count_if("significativo").over(Window.partitionBy("_m")))
            .withColumn("direcao", F.when(F.col("delta_mediana") > 0, F.lit(">")).otherwise(F.lit("<")))
            .drop("_m"))
