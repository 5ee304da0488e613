"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import secret_scan as secrets


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the base kinds counted and digested, and all spans."""
    out = secrets.scan(spark.read.parquet(table_path(sf_dir, "documents")))
    names = F.array(*[F.lit(r.name) for r in secrets.RULES])

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(k):
        # one argument: Spark gives a function of two the place in the array as the second
        return F.filter("spans", lambda s: s["kind"] == k)

    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{r.name}") for k, r in enumerate(secrets.BASE_RULES)]
    return out.select("doc_id", *count, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
