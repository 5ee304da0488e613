"""Shared inputs of the registered queries: the stand-in tables and filter specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sketches
from ..operators.filters import FilterSpec
from ..session import table_path
from ..sources import catalog, fixtures

# Filter used by the "filtered" variants (F1): two regions, two sizes, two statuses.
SPEC = FilterSpec.of(regions=["AMERICA", "ASIA"], sizes=["Pequeno", "Médio"], statuses=["F", "O"])
SPEC_SQL = ("regiao IN ('AMERICA','ASIA') AND class_tam_imovel IN ('Pequeno','Médio') "
            "AND status_imovel IN ('F','O')")


def M(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived fact table, materialised once per application."""
    return catalog.materialized(spark, "matches", sf_dir, lambda: fixtures.matches(spark, sf_dir, fixtures.join_tasks(spark, sf_dir)),
                                partition_by=("regiao",), cluster_by=("estado", "municipio_nome"),
                                inputs=tuple(table_path(sf_dir, t) for t in fixtures.INPUTS))


def by_property(spark: SparkSession, sf_dir: str) -> catalog.CoLocated:
    """The fact table bucketed by property, for work on each property by itself."""
    return catalog.co_located(spark, "matches_by_property", sf_dir, lambda: M(spark, sf_dir), "cod_imovel",
                              inputs=tuple(table_path(sf_dir, t) for t in fixtures.INPUTS))


#: Columns that the stored sketches of the properties can be filtered and grouped by.
SKETCH_DIMS = ("regiao", "estado", "municipio_nome", "ano_cadastro")


def property_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the properties by place and year, materialised once per application (A2, opt-in)."""
    return catalog.materialized(spark, "sketches", sf_dir,
                                lambda: sketches.distinct_sketches(M(spark, sf_dir), "cod_imovel", SKETCH_DIMS),
                                partition_by=("regiao",), inputs=tuple(table_path(sf_dir, t) for t in fixtures.INPUTS))


def R(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.raw_matches(spark, sf_dir)


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.read_table(spark, sf_dir, name)
