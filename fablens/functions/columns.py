"""Column helpers that all operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_ref(name: str) -> Column:
    """A column by its literal name, which may hold dots, spaces or per cent signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def present(value: Column) -> Column:
    """The value as a double; NaN and infinite values are taken as missing, as no bin or sum can hold them."""
    x = value.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def bucket(value: Column, lo: Column, hi: Column, k: int) -> Column:
    """Equal-width bin 0..k-1, left-closed, the last one with its upper end; bin 0 where all values are equal."""
    width = (hi - lo) / F.lit(float(k))
    return F.when(value.isNull(), None).when(width == 0, F.lit(0)).otherwise(F.least(F.floor((value - lo) / F.nullif(width, F.lit(0.0))), F.lit(k - 1))).cast("int")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs; null for a constant column, where ``corr`` would divide by zero."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
