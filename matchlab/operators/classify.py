"""Classification tables (C1-C5): reliability, risk, maturity, integration, area agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import labels as L
from . import aggregate as A
from .joins import attach_one_row, complete_domain


def quadrant(x, y, split_x: float, split_y: float, names: dict) -> Column:
    """Quadrant label of (x, y) split at (split_x, split_y); high means >= split."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return (F.when((x >= split_x) & (y >= split_y), F.lit(names["top_right"]))
            .when((x < split_x) & (y >= split_y), F.lit(names["top_left"]))
            .when((x >= split_x) & (y < split_y), F.lit(names["bottom_right"]))
            .when((x < split_x) & (y < split_y), F.lit(names["bottom_left"])))


def _pct(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of an empty whole."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def reliability_matrix(df: DataFrame, owner_label: str = "label_cpf", index: str = "indice") -> DataFrame:
    """2x2 (owner label, index >= .85) counts, share of total, action and
    display text; all four cells always present."""
    d = df.select(F.col(owner_label).alias("label_cpf"), X.threshold_label(index).alias("label_geo"))
    c = d.filter(F.col("label_cpf").isNotNull()).groupBy("label_cpf", "label_geo") \
        .agg(F.count(F.lit(1)).alias("n"))
    full = complete_domain(c, {"label_cpf": L.OWNER_LABELS, "label_geo": L.GEO_LABELS}, {"n": 0})
    tot = full.agg(F.sum("n").alias("_tot"))

    def action(texts):
        cells = F.create_map(*[x for (o, g), a in texts.items() for x in (F.lit(f"{o}|{g}"), F.lit(a))])
        return cells[F.concat_ws("|", "label_cpf", "label_geo")]

    j = attach_one_row(full, tot)
    return j.select("label_cpf", "label_geo", "n",
                    _pct(F.col("n"), F.col("_tot")).alias("pct"),
                    action(L.RELIABILITY_ACTIONS).alias("acao"), action(L.ANALYSIS_ACTIONS).alias("acao_analise"),
                    X.compact_number(F.col("n"), k_decimals=0, strict=True).alias("n_txt"))


def risk_matrix(df: DataFrame, owner_label: str = "label_cpf", index: str = "indice") -> DataFrame:
    """Owner label x five right-closed index bands: counts, column percent,
    row / column totals and their shares (long form, every cell present)."""
    d = df.filter(F.col(index).isNotNull() & ~F.isnan(index) & F.col(owner_label).isNotNull()) \
        .select(F.col(owner_label).alias("label_cpf"), X.risk_band(index).alias("faixa_risco"))
    c = d.filter(F.col("faixa_risco").isNotNull()).groupBy("label_cpf", "faixa_risco") \
        .agg(F.count(F.lit(1)).alias("n"))
    full = complete_domain(c, {"label_cpf": L.OWNER_LABELS, "faixa_risco": L.RISK_LABELS}, {"n": 0})
    from pyspark.sql import Window
    wc = Window.partitionBy("faixa_risco")
    wr = Window.partitionBy("label_cpf")
    tot = full.agg(F.sum("n").alias("_tot"))
    j = attach_one_row(full, tot)
    col_tot = F.sum("n").over(wc)
    row_tot = F.sum("n").over(wr)
    return j.select("label_cpf", "faixa_risco", "n",
                    _pct(F.col("n"), col_tot).alias("pct_col"),
                    col_tot.alias("col_total"), _pct(col_tot, F.col("_tot")).alias("col_share"),
                    row_tot.alias("row_total"), _pct(row_tot, F.col("_tot")).alias("row_share"))


def maturity_matrix(df: DataFrame, geo: Sequence[str], index: str = "indice", flag: str = "cpf_ok",
                    region: str = "regiao") -> DataFrame:
    """Per area % high index, % owner equal, region, n, bubble size and quadrant."""
    s = A.area_scorecard(df, geo, index, flag, region)
    s = A.minmax_rescale(s, "total_cars", L.BUBBLE_MIN, L.BUBBLE_MAX, "bubble_size")
    return s.withColumn("quadrante", quadrant("pct_espacial_bom", "pct_cpf_igual", L.MATURITY_SPLIT,
                                              L.MATURITY_SPLIT, L.MATURITY_QUADRANTS))


def integration_quadrants(rates: DataFrame, x: str, y: str) -> DataFrame:
    """C4: quadrant of two match rates split at 50/50."""
    return rates.withColumn("quadrante", quadrant(x, y, L.MATURITY_SPLIT, L.MATURITY_SPLIT,
                                                  L.INTEGRATION_QUADRANTS))


def area_agreement(df: DataFrame, discrepancy: str = "discrepancia") -> DataFrame:
    """Share of rows per open discrepancy band and per tolerance class."""
    pair = F.array(F.struct(F.lit("faixa").alias("kind"), X.discrepancy_band(discrepancy).alias("label")),
                   F.struct(F.lit("status").alias("kind"), X.tolerance_class(discrepancy).alias("label")))
    # both labels of a row are counted in one scan
    c = df.select(F.explode(pair).alias("s")).select("s.*").filter(F.col("label").isNotNull()) \
        .groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    return A.normalized_share(c, ["kind"], "n", "pct")
