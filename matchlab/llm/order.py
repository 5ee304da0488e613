"""The next row in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def with_next(df: DataFrame, order: list[str], wrap: bool = False) -> DataFrame:
    """``df`` (narrow rows, distinct in ``order``; null first) and ``next``: the struct of the
    following row's ``order`` columns; null after the last, or the first row if ``wrap``.

    Rows are dealt by ranges and written, so a hot prefix of the order is spread over
    many tasks. Inside a range a window finds the next row; the first row of each
    range, one per task, closes the gap to the range before."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    me = F.struct(*[F.col(c) for c in order])
    r = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    r = written(r, "ranges")
    r = r.withColumn("next", F.lead(me).over(Window.partitionBy("_part").orderBy(*keys)))
    first = r.groupBy("_part").agg(F.min(me).alias("_first"))
    parts = Window.orderBy("_part")  # one row per task of the ranges
    after = first.select("_part", F.lead("_first").over(parts).alias("_after"),
                         F.min("_first").over(Window.partitionBy(F.lit(0))).alias("_least"))
    end = F.coalesce("_after", "_least") if wrap else F.col("_after")
    r = r.join(after.select("_part", end.alias("_end")), "_part", "left")
    return r.withColumn("next", F.coalesce("next", "_end")).drop("_part", "_end")
