"""Filter interaction audit by Lehmer ranks and difference arrays.

k filters are applied in each of their k! orders. What an order removes at a step
depends on a document only through its mask, the set of filters that it fails: the step
removes the masks that hold the step's filter and none of the earlier ones. Orders are
numbered by their Lehmer rank (lexicographic). Orders that begin with the same letters
are neighbours, so the orders in which a mask goes at step s form intervals of ranks: one
for every beginning of s - 1 letters outside of the mask and one inside. A mask adds its
counts at the first rank of an interval and takes them off behind the last one; a prefix
sum over the ranks of a step gives all orders. The work after counting masks is of the
size of the answer and does not grow with the documents.

``failures`` finds the five filters' failures of documents; ``audit`` takes counts of any
masks. Documents are read once; narrow rows of them are written and joined on
(digest, id), so a text held by a third of all rows is no hot key.

Defined cases: a null text is empty (it fails A, and E if a smaller id is empty too); a
null part is the part ''; a row of null id is no copy of another, none is a copy of it,
and it has no labels; rows repeating an id and a text are no copies of each other; an id
with several labels is good or toxic if one label says so; null labels say nothing. Empty
documents give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def content_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails (bit k: letter k)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = (n < 50,
             100 * F.size(F.array_distinct(words)) < 65 * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
             text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters A to E that they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), content_failures(text).alias("mask"),
        # rows without an id meet nothing; their place in the scan keeps them apart
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0).alias("apart"))
    d = written(d, "audit-documents")
    first = d.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")) \
        .select("digest", "id", F.lit(0).cast("long").alias("apart"), F.lit(True).alias("first"))
    marked = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("id")) \
        .agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"),
             F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic")) \
        .withColumn("apart", F.lit(0).cast("long"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    d = d.join(first, ["digest", "id", "apart"], "left") \
        .select("id", "apart", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    d = d.join(marked, ["id", "apart"], "left")
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), *[
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): where a mask goes at a step.

    The rank of an order is the sum over its letters of (smaller letters not yet used) times
    the orders of the letters behind; a beginning covers the orders of what is left."""
    out = []

    def grow(used: int, rank: int, step: int, masks: list[int]) -> None:
        width = factorial(k - step)
        free = [x for x in range(k) if not used >> x & 1]
        for place, x in enumerate(free):
            lo = rank + place * width
            out.extend((m, step, lo, lo + width) for m in masks if m >> x & 1)
            if rest := [m for m in masks if not m >> x & 1]:
                grow(used | 1 << x, lo, step + 1, rest)

    grow(0, 0, 1, list(range(1, 1 << k)))
    return out


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. ``counts`` has (part, mask, n, good, toxic), masks being distinct
    within a part; ``letters`` (6 at most) in ascending order name the bits of a mask."""
    k = len(letters)
    spark = counts.sparkSession
    orders = ["".join(p) for p in permutations(letters)]  # in the order of their ranks
    bit = [F.col("mask").bitwiseAND(1 << j) for j in range(k)]
    per = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(b > 0, F.col("n")).otherwise(0)) for b in bit]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << j, F.col("n")).otherwise(0)) for j in range(k)]).alias("only"))

    # the intervals depend on k alone: under 2^k * k! rows
    where = F.broadcast(spark.createDataFrame(removal_intervals(k), "mask int, step int, lo int, hi int"))
    ends = F.array(F.struct(F.col("lo").alias("rank"), *[F.col(c) for c in COUNTS]),
                   F.struct(F.col("hi").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]))
    edges = counts.join(where, "mask").select("part", "step", F.explode(ends).alias("e")).select("part", "step", "e.*")
    grid = counts.select("part").distinct() \
        .select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")) \
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"),
                *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    # one exchange by part serves the sums and all windows below
    d = edges.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS]).unionByName(grid).repartition("part")
    d = d.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in COUNTS]).where(F.col("rank") < len(orders))
    d = d.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1))
    d = d.withColumn("j", F.expr(f"instr('{letters}', substring(filter_order, step, 1))"))
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("gone", gone).withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "j")))
    d = d.join(per, "part")
    return d.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", F.col("j")) - F.col("n")).alias("redundant"), F.element_at("only", F.col("j")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
