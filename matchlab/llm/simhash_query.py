"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import simhash
from .store import written

#: The search takes as queries every document whose id is divisible by this.
QUERY_EVERY = 50


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; n_near: documents within
    the radius of the fingerprint, itself included, for the search's queries (else null)."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    fp = written(simhash.edited_fingerprints(docs), "fingerprints")
    queries = fp.where(F.col("doc_id") % QUERY_EVERY == 0)
    sizes = fp.groupBy(F.col("fingerprint").alias("found")).agg(F.count("*").alias("docs"))
    near = simhash.within_radius(queries, fp).join(sizes, "found").groupBy("query").agg(F.sum("docs").alias("n_near"))
    out = fp.join(near, fp["fingerprint"] == near["query"], "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    f, e, n = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return out.select(
        "doc_id", F.col("n_chars").cast("long"), "edited_sha256", text(f).alias("fingerprint"),
        text(e).alias("edited_fingerprint"), simhash.likeness(f, e).alias("near_edited"),
        simhash.likeness(f, n).alias("near_next"),
        F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("n_near")).cast("long").alias("n_near"))
