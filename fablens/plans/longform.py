"""The long form: one row per unit and parameter.

Operators over many columns unpivot first and then group by parameter. One wide aggregate over a thousand columns makes
generated code too large to compile; the long form's plan has the same size at any number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_ref, numeric_columns, present


def long_form(df: DataFrame, params: list[str] | None = None, keep: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """keep... (called ``names``, if given), param, value (double; NaN and null are null). Only the named columns are read,
    whatever their names: a kept column may be called value or param if ``names`` says otherwise."""
    keep = keep or []
    names = names or keep
    params = [c for c in (params if params is not None else numeric_columns(df)) if c not in keep]
    kept = [col_ref(c).alias(n) for c, n in zip(keep, names, strict=True)]
    if not params:
        return df.select(*kept, F.lit(None).cast("string").alias("param"), F.lit(None).cast("double").alias("value")).limit(0)
    mark = "kept"
    while any(c.lower().startswith(mark) for c in params):
        mark = "_" + mark
    inner = [f"{mark}{i}" for i in range(len(keep))]
    narrow = df.select(*[col_ref(c).alias(n) for c, n in zip(keep, inner, strict=True)], *[present(col_ref(c)).alias(c) for c in params])
    return narrow.unpivot([col_ref(c) for c in inner], [col_ref(c) for c in params], "param", "value").withColumnsRenamed(dict(zip(inner, names, strict=True)))


def text_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (as text; NaN is null) for columns of any atomic type."""
    columns = columns if columns is not None else df.columns
    kinds = dict(df.dtypes)
    as_text = lambda c: F.when(~F.isnan(col_ref(c)), col_ref(c)) if kinds[c] in ("double", "float") else col_ref(c)
    narrow = df.select(*[as_text(c).cast("string").alias(c) for c in columns])
    return narrow.unpivot([], [col_ref(c) for c in columns], "column", "value")
