"""Connected components of an edge table by contraction to least neighbours.

Each round ties every vertex and all its neighbours to the least of them, until the
edges form stars around the least vertices. A round is a grouped minimum (combined
before the shuffle), a join and a distinct; its edges are written to the shared folder.
The minima are written too: both sides of the join are then plain shuffles, which is
what Spark needs to split the rows of a hot vertex, a star's centre, over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _contract(e: DataFrame) -> DataFrame:
    """One round on edges (u, v) with u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.join(least, "u").select("u", "v", "m")
    return out.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every vertex that isn't the least one
    of its component. ``edges`` has the columns u and v; null ends and loops are ignored."""
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v") \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = None
    while True:
        e = written(_contract(e), "edges")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
