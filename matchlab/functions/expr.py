"""Scalar Column -> Column expressions (projections P1-P30).

Every function here returns a ``pyspark.sql.Column`` built only from
built-in functions, so it stays inside whole-stage codegen and can be used
in ``select``/``withColumn``/``filter`` of batch or streaming DataFrames.
NaN is treated as missing wherever a comparison is involved (Spark orders
NaN above every number, pandas treats it as missing).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """Map NaN to NULL (double columns only)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


# --- P4: text-to-boolean normalisation -------------------------------------

def truthy(c) -> Column:
    """True when ``lower(cast(c as string))`` is one of the truthy texts; NULL -> false."""
    return F.coalesce(F.lower(_c(c).cast("string")).isin(*L.TRUTHY_TEXT), F.lit(False))


def truthy_flag(c) -> Column:
    return F.when(truthy(c), F.lit(1)).otherwise(F.lit(0))


def truthy_label(c, yes: str = L.OWNER_EQUAL, no: str = L.OWNER_DIFFERENT) -> Column:
    return F.when(truthy(c), F.lit(yes)).otherwise(F.lit(no))


def bool_label(c, yes: str = L.OWNER_EQUAL, no: str = L.OWNER_DIFFERENT) -> Column:
    """Strict map of a boolean: NULL stays NULL (notebook variant)."""
    c = _c(c)
    return F.when(c, F.lit(yes)).when(~c, F.lit(no))


# --- P5/P6: years --------------------------------------------------------

def year_from_text(c) -> Column:
    """Year of a date text; unparsable text -> NULL (TRY_CAST semantics)."""
    return F.year(_c(c).cast("string").try_cast("date")).cast("int")


def year_of(c) -> Column:
    return F.year(_c(c)).cast("int")


# --- P7-P10: generic banding ----------------------------------------------

def band(c, edges: Sequence[float], band_labels: Sequence[str], right: bool = False,
         include_lowest: bool = False, close_last: bool = False) -> Column:
    """Label of the bin that holds ``c``; values outside every bin, NULL and NaN -> NULL.

    right=False: bins [e_i, e_{i+1});  right=True: bins (e_i, e_{i+1}].
    include_lowest closes the first bin on the left (right=True),
    close_last closes the last bin on the right (right=False).
    Infinite edges mean the bin is unbounded on that side.
    """
    assert len(edges) == len(band_labels) + 1
    x = _c(c).cast("double")
    expr = None
    n = len(band_labels)
    for i, lab in enumerate(band_labels):
        lo, hi = edges[i], edges[i + 1]
        conds = []
        if not math.isinf(lo):
            lo_closed = (not right) or (include_lowest and i == 0)
            conds.append(x >= lo if lo_closed else x > lo)
        if not math.isinf(hi):
            hi_closed = right or (close_last and i == n - 1)
            conds.append(x <= hi if hi_closed else x < hi)
        cond = reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string")).otherwise(expr)


def band_ordinal(c, band_labels: Sequence[str]) -> Column:
    """1-based position of a band label in its ordered domain (NULL if absent)."""
    m = F.create_map(*[F.lit(v) for i, lab in enumerate(band_labels) for v in (lab, i + 1)])  # label -> position
    return m[_c(c)]


def jaccard_band(c) -> Column:
    """[0,.25) [.25,.5) [.5,.85) [.85,1] on the 0-1 scale."""
    return band(c, L.JACCARD_EDGES, L.JACCARD_LABELS, right=False, close_last=True)


def jaccard_pct_band(c) -> Column:
    """Right-open bins [0,25,50,85,100.1) on the percent scale."""
    return band(c, L.JACCARD_PCT_EDGES, L.JACCARD_LABELS, right=False)


def risk_band(c) -> Column:
    """Five right-closed bins of width .2, lowest edge included."""
    return band(c, L.RISK_EDGES, L.RISK_LABELS, right=True, include_lowest=True)


def discrepancy_band(c) -> Column:
    """P10: open-ended right-closed bins at -10, -1, 1, 10 percent."""
    return band(c, L.DISCREPANCY_EDGES, L.DISCREPANCY_LABELS, right=True)


def require_columns(df, names) -> None:
    """One clear error that names every column an input lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")


# --- P11: size class -------------------------------------------------------

def size_class(c, decimal_round: bool = True) -> Column:
    """<= 4 'Pequeno', <= 15 'Médio', else (NULL included) 'Grande'.

    With decimal_round the value is rounded HALF_UP to 4 places as a decimal
    first, like ``round(x::numeric, 4)``.
    """
    x = _c(c)
    if decimal_round:
        x = F.round(x.cast("decimal(20,6)"), 4)
    return (F.when(x <= L.SIZE_SMALL_MAX, F.lit(L.SIZE_LABELS[0]))
            .when(x <= L.SIZE_MEDIUM_MAX, F.lit(L.SIZE_LABELS[1]))
            .otherwise(F.lit(L.SIZE_LABELS[2])))


# --- P12, P22, P30: guarded arithmetic --------------------------------------

def relative_diff_pct(a, b) -> Column:
    """((a - b) / nullif(b, 0)) * 100; zero divisor -> NULL."""
    a, b = _c(a), _c(b)
    return ((a - b) / F.nullif(b, F.lit(0))) * 100


def safe_pct(part, total) -> Column:
    """part / total * 100 when total > 0, else 0."""
    part, total = _c(part), _c(total)
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def jaccard_from_areas(area_a, area_b, area_inter) -> Column:
    """inter / (a + b - inter); empty union -> NULL."""
    a, b, i = _c(area_a), _c(area_b), _c(area_inter)
    return i / F.nullif(a + b - i, F.lit(0))


# --- P13, P14: classes -------------------------------------------------------

def tolerance_class(c, limit: float = L.TOLERANCE_LIMIT, null_as_else: bool = False) -> Column:
    """'Preciso' within +/-limit, over above, under below; NULL stays NULL
    unless ``null_as_else`` copies the reference's else-branch."""
    x = nan_to_null(c)
    e = (F.when(x.between(-limit, limit), F.lit(L.TOLERANCE_OK))
         .when(x > limit, F.lit(L.TOLERANCE_OVER)))
    if null_as_else:
        return e.otherwise(F.lit(L.TOLERANCE_UNDER))
    return e.when(x < -limit, F.lit(L.TOLERANCE_UNDER))


def threshold_label(c, threshold: float = L.HIGH_INDEX,
                    high: str = L.GEO_HIGH, low: str = L.GEO_LOW) -> Column:
    """'>= 85%' when c >= threshold; NULL/NaN count as below (pandas semantics)."""
    x = nan_to_null(c)
    return F.when(x >= threshold, F.lit(high)).otherwise(F.lit(low))


def high_flag(c, threshold: float = L.HIGH_INDEX) -> Column:
    x = nan_to_null(c)
    return F.when(x >= threshold, F.lit(1)).otherwise(F.lit(0))


# --- P16: dictionary lookup, three flavours -----------------------------------

def _map_expr(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_strict(c, mapping: Mapping) -> Column:
    """Unmatched keys -> NULL (pandas ``map``)."""
    return _map_expr(mapping)[_c(c)]


def map_replace(c, mapping: Mapping) -> Column:
    """Unmatched keys keep their value (pandas ``replace``)."""
    return F.coalesce(_map_expr(mapping)[_c(c)], _c(c))


def map_default(c, mapping: Mapping, default) -> Column:
    """Unmatched keys -> default (``dict.get(k, d)``)."""
    return F.coalesce(_map_expr(mapping)[_c(c)], F.lit(default))


# --- P17, P18, P29: text ------------------------------------------------------

def capitalize(c) -> Column:
    """First character upper, the rest lower (pandas ``str.capitalize``)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def text_prefix(c, n: int = 4) -> Column:
    return F.substring(_c(c).cast("string"), 1, n)


def slug(c) -> Column:
    """strip, lower, '-' and ' ' -> '_'."""
    return F.translate(F.lower(F.trim(_c(c))), "- ", "__")


def first_token(c) -> Column:
    return F.split(F.trim(_c(c)), " ").getItem(0)


def code2(c) -> Column:
    """First two characters, upper case (``s[:2].upper()``)."""
    return F.upper(F.substring(_c(c), 1, 2))


def state_code(c) -> Column:
    """First space-separated token when the text has a space, else its first two characters."""
    c = _c(c)
    return F.when(c.contains(" "), F.split(c, " ").getItem(0)).otherwise(F.substring(c, 1, 2))


def title_case(c) -> Column:
    """Python ``str.title()``: lower-case, then upper-case every letter that
    follows a non-letter (``initcap`` only splits on spaces).  A fold over the
    characters of each (short) label."""
    low = F.lower(_c(c))
    chars = F.split(F.substring(low, 2, 1 << 30), "")
    init = F.struct(F.upper(F.substring(low, 1, 1)).alias("out"),
                    F.substring(low, 1, 1).rlike(r"\p{L}").alias("prev"))

    def step(acc, ch):
        return F.struct(F.concat(acc["out"], F.when(acc["prev"], ch).otherwise(F.upper(ch))).alias("out"),
                        ch.rlike(r"\p{L}").alias("prev"))
    return F.when(low.isNull(), F.lit(None).cast("string")).otherwise(F.aggregate(chars, init, step)["out"])


def display_name(c, mapping: Mapping) -> Column:
    """Display label: dictionary value, else the title-cased code (``d.get(k, k.title())``)."""
    return F.coalesce(_map_expr(mapping)[_c(c)], title_case(c))


# --- P20, P21 -------------------------------------------------------------

def row_sum(cols: Sequence) -> Column:
    """Row-wise sum that skips missing values (pandas ``sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(x), F.lit(0.0)) for x in cols])


# --- P26: compact number text -----------------------------------------------

def _fixed(c: Column, decimals: int) -> Column:
    """Python-style fixed-point text: ties to even (DecimalFormat default, like
    Python's format), no thousands separators."""
    return F.regexp_replace(F.format_number(c.cast("double"), decimals), ",", "")


def compact_number(c, k_decimals: int = 1, m_decimals: int = 1, strict: bool = False, prefix: str = "",
                   k_suffix: str = "K", m_suffix: str = "M") -> Column:
    """>= 1e6 -> 'x.xM', >= 1e3 -> 'x.xK', else integer text, with an optional
    prefix (currency) and suffix texts ('Mi', ' K', ...).

    ``strict`` uses '>' instead of '>=' (the reliability-matrix variant)."""
    x = _c(c).cast("double")
    ge = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    p = F.lit(prefix)
    return (F.when(ge(x, 1_000_000), F.concat(p, _fixed(x / 1_000_000, m_decimals), F.lit(m_suffix)))
            .when(ge(x, 1_000), F.concat(p, _fixed(x / 1_000, k_decimals), F.lit(k_suffix)))
            .otherwise(F.concat(p, _fixed(x, 0))))


def value_text(c, fmt: str = "number") -> Column:
    """Chart value label: 'percent' -> '12%', 'currency' -> 'R$1.2M' / 'R$12K' / 'R$12',
    otherwise '1.2M' / '12K' / '12'."""
    if fmt == "percent":
        return pct_text(c, 0)
    prefix = L.CURRENCY_PREFIX if fmt == "currency" else ""
    return compact_number(c, k_decimals=0, m_decimals=1, prefix=prefix)


def grouped_number(c, decimals: int = 0, prefix: str = "") -> Column:
    """Thousands-separated fixed-point text ('R$1,234,568'), ties to even."""
    return F.concat(F.lit(prefix), F.format_number(_c(c).cast("double"), decimals))


def area_text(c) -> Column:
    """Area with unit choice: ha / mil ha / M ha."""
    x = _c(c).cast("double")
    return (F.when(x >= 1_000_000, F.concat(_fixed(x / 1_000_000, 1), F.lit(" M ha")))
            .when(x >= 1_000, F.concat(_fixed(x / 1_000, 1), F.lit(" mil ha")))
            .otherwise(F.concat(_fixed(x, 0), F.lit(" ha"))))


def pct_text(c, decimals: int = 1) -> Column:
    return F.concat(_fixed(_c(c), decimals), F.lit("%"))


def count_share_text(label, n, pct) -> Column:
    """'label (n - p%)'."""
    return F.concat(_c(label), F.lit(" ("), _c(n).cast("string"), F.lit(" - "),
                    _fixed(_c(pct), 1), F.lit("%)"))


# --- P27, P28: qualified place names ------------------------------------------

def qualified_name(name, state, n_states) -> Column:
    """'name - UF' when the name occurs in more than one state, else name."""
    return F.when(_c(n_states) > 1, F.concat_ws(" - ", _c(name), _c(state))).otherwise(_c(name))


def split_qualified(c) -> tuple[Column, Column]:
    """Split on the LAST ' - ': (name, state); state NULL when absent."""
    c = _c(c)
    has = c.contains(" - ")
    name = F.when(has, F.trim(F.regexp_extract(c, r"^(.*) - (.*?)$", 1))).otherwise(F.trim(c))
    st = F.when(has, F.trim(F.regexp_extract(c, r"^(.*) - (.*?)$", 2)))
    return name, st
