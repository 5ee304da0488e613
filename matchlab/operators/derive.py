"""Derived columns of the match table (load step)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def derive_matches(raw: DataFrame, index: str = "indice", owner_text: str = "igualdade_txt",
                   date_text: str = "data_cadastro_imovel", size: str = "num_modulo",
                   area_a: str = "area_a", area_b: str = "area_b") -> DataFrame:
    """Derived columns of the fact table (computed once, lazily, in one projection).

    NaN in a double column becomes NULL first, so no aggregate is poisoned by it.
    ``withColumns`` replaces a column the raw file already carries (e.g. a
    previously derived ``ano_cadastro``) instead of duplicating it."""
    X.require_columns(raw, [index, owner_text, date_text, size, area_a, area_b])
    raw = raw.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in raw.schema
                           if f.dataType.typeName() in ("double", "float")})
    return raw.withColumns({
        "cpf_ok": X.truthy_flag(owner_text),
        "label_cpf": X.truthy_label(owner_text),
        "ano_cadastro": X.year_from_text(date_text),
        "faixa_jaccard": X.jaccard_band(index),
        "class_tam_imovel": X.size_class(size),
        "discrepancia": X.relative_diff_pct(area_a, area_b),
    })
