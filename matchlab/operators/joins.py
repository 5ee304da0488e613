"""Joins (J1-J11).

Join strategy is left to Catalyst/AQE (broadcast when the runtime size is
under ``spark.sql.autoBroadcastJoinThreshold``, sort-merge otherwise).  We
only force ``broadcast`` where the side has a size bound by construction:
a one-row aggregate, a literal domain, a fixed-size top-k list.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a small table that may be broadcast (some MB).
FEW_ROWS = 100_000


def few(small: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A small aggregated table with a broadcast hint behind a check of its rows, made when the
    plan runs: beyond ``most`` rows the query ends with an error that says so, before
    anything is broadcast. Callers offer a form without the hint for such tables."""
    # grouped by a constant: an empty table stays empty, and Spark drops what is joined to it
    rows = small.limit(most + 1).groupBy(F.lit(0).alias("_k")).agg(F.collect_list(F.struct(*small.columns)).alias("_all"))
    error = F.raise_error(F.lit(f"more than {most} rows to broadcast: use wide=True"))
    return F.broadcast(rows.select(F.inline(F.when(F.size("_all") <= most, F.col("_all")).otherwise(error))))


def scalar_struct(one_row: DataFrame) -> Column:
    """The single row of a global aggregate as one scalar-subquery struct
    (computed once, inlined as a value; NULL when the aggregate has no row)."""
    return one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row.

    A scalar subquery, not a join: Spark evaluates the aggregate once and
    uses its value in the projection of every row."""
    s = scalar_struct(one_row)
    return df.withColumns({c: s[c] for c in one_row.columns})




def complete_domain(counts: DataFrame, domains: Mapping[str, Sequence], fill: Mapping[str, object],
                    order_cols: Mapping[str, str] | None = None) -> DataFrame:
    """Every combination of the listed labels present, missing counts filled.

    ``domains`` maps key column -> ordered label list (small, literal); the
    product of the domains is built from literals and left-joined to ``counts``.
    """
    spark = counts.sparkSession
    order_cols = order_cols or {}
    keys = list(domains)
    # The label product is small and literal: build it on the driver.
    rows = [tuple(v for pair in combo for v in pair)
            for combo in itertools.product(*[[(v, i + 1) for i, v in enumerate(domains[k])]
                                             for k in keys])]
    schema = ", ".join(f"{k} string, {order_cols.get(k, '_ord_' + k)} int" for k in keys)
    dom = spark.createDataFrame(rows, schema)
    out = dom.join(counts, keys, "left").fillna(dict(fill))
    drop = [c for c in out.columns if c.startswith("_ord_")]
    return out.drop(*drop)


def left_join_fill(left: DataFrame, right: DataFrame, left_on: str | Sequence[str],
                   right_on: str | Sequence[str] | None = None, fill: Mapping | None = None,
                   suffix: str = "_dir") -> DataFrame:
    """Left join, right key renamed away, overlapping names suffixed, nulls filled."""
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    ren = {}
    for c in right.columns:
        if c in rk:
            continue
        if c in left.columns:
            ren[c] = c + suffix
    r = right.withColumnsRenamed(ren) if ren else right
    r = r.withColumnsRenamed({b: f"_rk{i}" for i, b in enumerate(rk)})
    cond = [left[a] == r[f"_rk{i}"] for i, a in enumerate(lk)]
    out = left.join(r, cond, "left").drop(*[f"_rk{i}" for i in range(len(rk))])
    return out.fillna(dict(fill)) if fill else out


def full_join_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: Mapping) -> DataFrame:
    """Full outer join with coalesced keys and zero-filled counts."""
    return a.join(b, list(keys), "full").fillna(dict(fill))


def distinct_attributes(df: DataFrame, stats: DataFrame, key: str | Sequence[str],
                        attrs: Sequence[str]) -> DataFrame:
    """Stats left-joined to the de-duplicated (key, attrs) projection of df."""
    k = [key] if isinstance(key, str) else list(key)
    return stats.join(df.select(*k, *attrs).distinct(), k, "left")


#: Points of a block of near pairs; a cell of more is cut.
BLOCK_POINTS = 4096
#: Halvings of a cell's sides at most: deeper, points are told apart by a hash.
MAX_DEPTH = 5
_KEY = ["_gx", "_gy", "_box", "_h", "_px", "_py", "_pbox", "_ph"]


def _box(x: Column, y: Column, cx: Column, cy: Column, depth: Column, radius: float) -> Column:
    """The number of a point's box in its cell, whose sides are halved ``depth`` times."""
    n = F.pow(F.lit(2), depth).cast("int")
    at = lambda v, c: F.greatest(F.lit(0), F.least(n - 1, F.floor((v / radius - c) * n).cast("int")))
    return at(y, cy) * n + at(x, cx)


def _blocks_near(x: Column, y: Column, cx: Column, cy: Column, depth: Column, boxes: Column, radius: float) -> Column:
    """array<struct<box, h>>: the blocks of a dense cell's boxes that reach within ``radius`` of a point."""
    n = F.pow(F.lit(2), depth).cast("int")
    side = radius / n

    def gap(v, cell, place):
        lo = cell * radius + place * side
        return F.greatest(lo - v, v - lo - side, F.lit(0.0))

    def near(e):  # a little more than the radius: the borders of boxes are rounded
        dx, dy = gap(x, cx, e["key"] % n), gap(y, cy, F.floor(e["key"] / n))
        return dx * dx + dy * dy <= radius * radius * (1 + 1e-9)

    return F.flatten(F.transform(F.filter(F.map_entries(boxes), near), lambda e: F.transform(
        F.sequence(F.lit(0), e["value"] - 1), lambda h: F.struct(e["key"].alias("box"), h.alias("h")))))


def near_blocks(points: DataFrame, id_col: str, x: str, y: str, radius: float, keep: Sequence[str] = (),
                block: int = BLOCK_POINTS, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two sides of the near pairs' equi-join, with the key columns _KEY: (probe, build).

    A cell of more than ``block`` points is a quadtree: its sides are halved until a box holds
    about a block, at most MAX_DEPTH times; what is denser yet is cut by a hash of the id. A point
    goes to the blocks that reach within the radius, so a key holds a block of each side."""
    cx, cy = F.floor(F.col(x) / radius).cast("long"), F.floor(F.col(y) / radius).cast("long")
    cols = [id_col, x, y, *keep]
    pts = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*cols, cx.alias("_cx"), cy.alias("_cy"))
    X, Y = F.col(x), F.col(y)
    deep = F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(F.col("_n") / block) / 2)).cast("int")
    dense = pts.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("_cx", "_cy", deep.alias("_d"))
    small = (lambda d: d) if wide else few  # a row per dense cell
    boxes = pts.join(small(dense), ["_cx", "_cy"]).groupBy(
        "_cx", "_cy", "_d", _box(X, Y, F.col("_cx"), F.col("_cy"), F.col("_d"), radius).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.struct(F.col("_b"), F.ceil(F.col("_n") / block).cast("int"))
    dense = boxes.groupBy("_cx", "_cy", "_d").agg(F.map_from_entries(F.collect_list(cut)).alias("_boxes"))

    own = pts.join(small(dense), ["_cx", "_cy"], "left")
    own = own.withColumn("_b", F.when(F.col("_d").isNotNull(), _box(X, Y, F.col("_cx"), F.col("_cy"), F.col("_d"), radius)).otherwise(0))
    own = own.withColumn("_own_h", F.when(F.col("_d").isNotNull(), F.pmod(F.xxhash64(id_col), F.element_at("_boxes", F.col("_b")))).otherwise(0).cast("int"))
    offsets = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))

    def around(sign):
        return F.explode(F.array(*[F.struct((F.col("_cx") + sign * dx).alias("x"), (F.col("_cy") + sign * dy).alias("y")) for dx, dy in offsets]))

    # who asks: the cell, box and block of a dense cell's point; all other cells ask as one
    asks = F.col("_d").isNotNull()
    me = [F.when(asks, F.col(c)).otherwise(0).alias(k) for c, k in (("_cx", "_px"), ("_cy", "_py"))] + \
        [F.when(asks, F.col(c)).otherwise(-1).alias(k) for c, k in (("_b", "_pbox"), ("_own_h", "_ph"))]
    probe = own.select(*cols, "_cx", "_cy", *me, around(1).alias("_o")) \
        .select("*", F.col("_o.x").alias("_gx"), F.col("_o.y").alias("_gy")) \
        .join(small(dense.select(F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy"), "_d", "_boxes")), ["_gx", "_gy"], "left")
    to = F.when(F.col("_d").isNotNull(), _blocks_near(X, Y, F.col("_gx"), F.col("_gy"), F.col("_d"), F.col("_boxes"), radius)) \
        .otherwise(F.array(F.struct(F.lit(0).alias("box"), F.lit(0).alias("h"))))
    probe = probe.select(*cols, ((F.col("_gx") == F.col("_cx")) & (F.col("_gy") == F.col("_cy"))).alias("_same"),
                         "_gx", "_gy", "_px", "_py", "_pbox", "_ph", F.explode(to).alias("_t")) \
        .select(*cols, "_same", F.col("_t.box").alias("_box"), F.col("_t.h").alias("_h"), *[k for k in _KEY if k not in ("_box", "_h")])

    here = [F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy"), F.col("_b").alias("_box"), F.col("_own_h").alias("_h")]
    zero, none = F.lit(0).cast("long"), F.lit(-1)
    build = own.select(*cols, *here, zero.alias("_px"), zero.alias("_py"), none.alias("_pbox"), none.alias("_ph"))
    asked = own.select(*cols, *here, around(-1).alias("_o")).select("*", F.col("_o.x").alias("_px"), F.col("_o.y").alias("_py")) \
        .join(small(dense.select(F.col("_cx").alias("_px"), F.col("_cy").alias("_py"), "_d", "_boxes")), ["_px", "_py"])
    asked = asked.select(*cols, "_gx", "_gy", "_box", "_h", "_px", "_py", F.explode(
        _blocks_near(X, Y, F.col("_px"), F.col("_py"), F.col("_d"), F.col("_boxes"), radius)).alias("_t"))
    asked = asked.select(*cols, "_gx", "_gy", "_box", "_h", "_px", "_py", F.col("_t.box").alias("_pbox"), F.col("_t.h").alias("_ph"))
    return probe, build.unionByName(asked)


def pairs_within(points: DataFrame, id_col: str, x: str, y: str, radius: float,
                 keep: Sequence[str] = (), block: int = BLOCK_POINTS, wide: bool = False) -> DataFrame:
    """Unordered pairs (i < j) with Euclidean distance < radius.

    Grid equi-join: cell = floor(coord / radius); each point meets only the
    points of its own cell and of 4 of the 8 cells around it (the other 4 meet it
    from their side), never a cartesian product. Dense cells are cut into blocks
    (``near_blocks``), and a task compares a block with a block. The table of dense cells
    is broadcast behind a check of its rows; ``wide`` leaves that join to Spark.
    """
    cols = [id_col, x, y, *keep]
    probe, build = near_blocks(points, id_col, x, y, radius, keep, block, wide)
    j = probe.withColumnsRenamed({c: f"{c}_1" for c in cols}).join(build.withColumnsRenamed({c: f"{c}_2" for c in cols}), _KEY)
    dx = F.col(f"{x}_1") - F.col(f"{x}_2")
    dy = F.col(f"{y}_1") - F.col(f"{y}_2")
    d2 = dx * dx + dy * dy
    less = F.col(f"{id_col}_1") < F.col(f"{id_col}_2")
    near = j.filter((d2 < radius * radius) & F.when(F.col("_same"), less).otherwise(F.col(f"{id_col}_1") != F.col(f"{id_col}_2")))
    first = [F.when(less, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_1") for c in cols]
    second = [F.when(less, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(f"{c}_2") for c in cols]
    return near.select(*first, *second, F.sqrt(d2).alias("distance"))


def group_pairs(df: DataFrame, group: str) -> DataFrame:
    """All unordered pairs (g1 < g2) of the distinct, non-null groups of ``group``.

    The input is the distinct-group table (k rows), so the result is C(k, 2) rows."""
    g = df.select(group).filter(F.col(group).isNotNull()).distinct()
    a = g.select(F.col(group).alias("grupo_1"))
    b = g.select(F.col(group).alias("grupo_2"))
    return a.join(b, F.col("grupo_1") < F.col("grupo_2"))


#: Rows of one key from which its dimension row travels to them instead of them to it.
HOT_ROWS = 1_000_000


def split_hot_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` to the rows of ``right`` (any number a key), split by how often
    ``left`` holds a key: the right rows of its hot keys are broadcast (there are at most
    |left| / ``hot_rows`` such keys; ``few`` checks the rows), all others are joined by shuffle.
    So no task gets the left rows of a hot key; null keys meet nothing and stay out."""
    left = left.where(F.col(key).isNotNull())
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select(key)
    of_hot = few(right.join(few(hot), key, "left_semi"))
    return left.join(of_hot, key).unionByName(left.join(few(hot), key, "left_anti").join(right, key))


def best_match_by_owner(matches: DataFrame, bridge: DataFrame, owners: DataFrame, parcels: DataFrame,
                        key: str, parcel: str, index: str, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """J1 over the n:m owner bridge + W1: the first match of every ``key`` by ``index`` (descending, a
    missing one first), then a match whose parcel has the code of one of the key's owners
    (column ``mesmo_dono``), then ``order``.

    ``bridge`` is (key, owner), ``owners`` (owner, owner_code), ``parcels`` (parcel, parcel_code). Matches
    without a parcel and keys without an owner drop out, as in inner joins. Whether a key
    has an owner is the same for all its matches, so its matches of the best index are taken
    first (mostly one; pruned before the shuffle), and only they fan out over its owners."""
    top = Window.partitionBy(key).orderBy(F.col(index).desc_nulls_first())
    m = matches.join(parcels, parcel).withColumn("_rank", F.rank().over(top)).where("_rank = 1").drop("_rank")
    codes = split_hot_join(bridge, owners, "owner", hot_rows).select(key, "owner_code")
    fan = m.join(codes, key).withColumn("mesmo_dono", F.coalesce(F.col("owner_code") == F.col("parcel_code"), F.lit(False)))
    first = Window.partitionBy(key).orderBy(F.col("mesmo_dono").desc(), *order)
    return fan.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, index, "mesmo_dono", *order)


def equality_flag(a: str | Column, b: str | Column) -> Column:
    """Nullable boolean equality of two keys from different sources."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a == b
