"""Filters and predicates.

A ``FilterSpec`` is a frozen description of the dashboard filters.  It
compiles to one Column predicate (no SQL text), so Catalyst pushes the
simple IN-lists down to the parquet scan and folds an empty spec to TRUE.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def _clean(values: Iterable | None) -> tuple:
    """Blank / None entries removed, whitespace stripped (F1)."""
    if not values:
        return ()
    out = []
    for v in values:
        if v is None:
            continue
        s = str(v).strip()
        if s:
            out.append(s)
    return tuple(out)


@dataclass(frozen=True)
class Columns:
    region: str = "regiao"
    state: str = "estado"
    place: str = "municipio_nome"
    size: str = "class_tam_imovel"
    status: str = "status_imovel"
    year: str = "ano_cadastro"


@dataclass(frozen=True)
class FilterSpec:
    regions: tuple = ()
    states: tuple = ()
    places: tuple = ()       # bare names or 'name - UF'
    sizes: tuple = ()
    statuses: tuple = ()
    year_min: int | None = None
    year_max: int | None = None
    cols: Columns = Columns()

    @classmethod
    def of(cls, regions=None, states=None, places=None, sizes=None, statuses=None,
           year_min=None, year_max=None, cols: Columns = Columns()) -> "FilterSpec":
        return cls(_clean(regions), _clean(states), _clean(places), _clean(sizes),
                   _clean(statuses), year_min, year_max, cols)

    def resolved(self) -> "FilterSpec":
        """place beats state beats region (the others are dropped)."""
        if self.places:
            return replace(self, regions=(), states=())
        if self.states:
            return replace(self, regions=())
        return self

    def relax_states(self) -> "FilterSpec":
        """same spec without the state and place filters."""
        return replace(self, states=(), places=())

    # -- predicate -----------------------------------------------------------
    def predicate(self) -> Column:
        c = self.cols
        preds: list[Column] = []
        if self.regions:
            preds.append(F.col(c.region).isin(*self.regions))
        if self.states:
            preds.append(F.col(c.state).isin(*self.states))
        if self.places:
            preds.append(place_predicate(self.places, c.place, c.state))
        if self.sizes:
            preds.append(F.col(c.size).isin(*self.sizes))
        if self.statuses:
            preds.append(F.col(c.status).isin(*self.statuses))
        if self.year_min is not None:
            preds.append(F.col(c.year) >= self.year_min)
        if self.year_max is not None:
            preds.append(F.col(c.year) <= self.year_max)
        return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)  # F4

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that pass; place beats state beats region (F3), always."""
        return df.filter(self.resolved().predicate())


def place_predicate(places: Sequence[str], name_col: str, state_col: str) -> Column:
    """OR of (name = n AND state = uf) for 'n - uf' entries and (name = n) for bare ones.

    Split on the last ' - ' as the reference does (P28)."""
    bare, qualified = [], []
    for p in places:
        if " - " in p:
            n, uf = p.rsplit(" - ", 1)
            qualified.append((n.strip(), uf.strip()))
        else:
            bare.append(p.strip())
    terms: list[Column] = []
    if bare:
        terms.append(F.col(name_col).isin(*bare))
    for n, uf in qualified:
        terms.append((F.col(name_col) == n) & (F.col(state_col) == uf))
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(True)


#: Values of a selection table that go to the scan as an array; longer ones are left to the join.
FEW_VALUES = 200


def _at_scan(values: DataFrame, column: str) -> tuple[Column, Column]:
    """(the selection is empty, a row may pass) for a one-column table of values: a scalar subquery
    takes up to ``FEW_VALUES`` + 1 of them. On a partition column the scan evaluates it when the query
    runs and opens the folders it leaves; on another one it spares the join the other rows."""
    few = values.limit(FEW_VALUES + 1).agg(F.collect_set(values.columns[0])).scalar()
    empty = F.size(few) == 0
    return empty, empty | (F.size(few) > FEW_VALUES) | F.array_contains(few, F.col(column))


def place_filter_from_table(df: DataFrame, selection: DataFrame, name_col: str = "municipio_nome",
                            state_col: str = "estado") -> DataFrame:
    """F2 for a selection held in a DataFrame (column ``place``) of bare and qualified names. Blanks are
    ignored, and a selection without names filters nothing (F4). The facts are scanned once."""
    sel = selection.select(F.trim("place").alias("place")).where(F.col("place") != "")
    name, st = X.split_qualified(F.col("place"))
    sel = sel.select(name.alias("_n"), st.alias("_s")).distinct()
    empty, may_pass = _at_scan(sel.select("_n").distinct(), name_col)
    bare = sel.where("_s IS NULL").select(F.col("_n").alias("_bare"))
    full = sel.where("_s IS NOT NULL").select(F.col("_n").alias("_name"), F.col("_s").alias("_state"))
    j = df.filter(may_pass).join(bare, F.col(name_col) == F.col("_bare"), "left").join(
        full, (F.col(name_col) == F.col("_name")) & (F.col(state_col) == F.col("_state")), "left")
    return j.filter(empty | F.col("_bare").isNotNull() | F.col("_name").isNotNull()).select(*df.columns)


def isin_or_semijoin(df: DataFrame, column: str, values: DataFrame | Sequence) -> DataFrame:
    """F1 for a selection given as a list or as a one-column table of any length. Either
    way blanks are ignored, and a selection without values filters nothing (F4). A list is
    an IN-list of constants; a table is a join, which Spark broadcasts by its size, behind a filter
    that prunes the scan when the query runs. The facts are scanned once."""
    if not isinstance(values, DataFrame):
        vals = _clean(values)
        return df.filter(F.col(column).isin(*vals)) if vals else df
    v = values.select(F.trim(F.col(values.columns[0]).cast("string")).alias("_value")).filter(F.col("_value") != "")
    v = v.select(F.col("_value").try_cast(df.schema[column].dataType).alias("_value")).distinct()
    # a value that the column's type can't hold matches nothing, but it is a selection
    empty = v.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    v = v.where("_value IS NOT NULL")
    _, may_pass = _at_scan(v, column)
    j = df.filter(may_pass).join(v, F.col(column) == F.col("_value"), "left")
    return j.filter(empty | F.col("_value").isNotNull()).select(*df.columns)


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def in_range(c, lo, hi) -> Column:
    """closed range lo <= c <= hi."""
    return X._c(c).between(lo, hi)


def complete_groups(membership: DataFrame, selected: DataFrame, group: str, member: str) -> DataFrame:
    """Groups all of whose members appear in ``selected`` (relational division).

    membership: (group, member) pairs; selected: one column with members.
    """
    sel = selected.select(F.col(selected.columns[0]).alias("_m")).distinct().withColumn("_hit", F.lit(1))
    m = membership.select(group, member).distinct()
    j = m.join(sel, m[member] == sel["_m"], "left")
    return (j.groupBy(group)
            .agg(F.min(F.coalesce(F.col("_hit"), F.lit(0))).alias("_all"))
            .filter(F.col("_all") == 1)
            .select(group))


def context_rows(df: DataFrame, spec: FilterSpec, membership: DataFrame) -> DataFrame:
    """the panorama behind a state-filtered view. The state and place filters are
    dropped, and the rows are those of the explicit regions; without any, of the regions
    all of whose states are selected (F10, by the dimension ``membership`` of (region,
    state)); without any of these, of all regions. If no row is left, or no state is
    selected, the filtered rows themselves.

    All branches are planned lazily and gated by scalar counts, so no driver round trip
    decides between them."""
    c = spec.cols
    if not spec.states:
        return spec.apply(df)
    relaxed = spec.relax_states()
    rows = relaxed.apply(df)
    if not spec.regions:
        selected = df.sparkSession.createDataFrame([(s,) for s in spec.states], f"{c.state} string")
        comp = complete_groups(membership.dropna(), selected, c.region, c.state)
        none = comp.agg(F.count(F.lit(1))).scalar() == 0
        rows = rows.join(comp, c.region, "left_semi").unionByName(rows.filter(none))
    left = rows.limit(1).agg(F.count(F.lit(1))).scalar()
    return rows.unionByName(spec.apply(df).filter(left == 0))


def guard_min_rows(df: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """return ``df`` only when it has >= k rows (> k with strict); else empty.

    Plan-level HAVING: a count of as many rows as decide it, used as a scalar
    subquery in the filter, no driver count() and no scan to the end.
    """
    least = k + 1 if strict else k
    n = df.limit(max(least, 0)).agg(F.count(F.lit(1)).alias("_n")).scalar()
    return df.filter(n >= least)
