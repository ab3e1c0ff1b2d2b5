"""Derived features: deviations from nominal, absolute values, differences between stages, subsets and projections."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_ref


def nominal(category: Column, nominals: dict[str, float]) -> Column:
    """The category's nominal value; null for one that has none."""
    if not nominals:
        return F.lit(None).cast("double")
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in nominals.items()))[category]


def with_nominal(df: DataFrame, category: str, nominals: dict[str, float], out: str = "nominal") -> DataFrame:
    return df.withColumn(out, nominal(col_ref(category), nominals))


def with_deviation(df: DataFrame, value: str, target: float | Column, out: str) -> DataFrame:
    """|value - target|; the target is a number or a column, such as ``nominal``."""
    return df.withColumn(out, F.abs(col_ref(value) - (target if isinstance(target, Column) else F.lit(float(target)))))


def with_abs(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.abs(col_ref(value)))


def with_delta(df: DataFrame, later: str, earlier: str, out: str) -> DataFrame:
    return df.withColumn(out, col_ref(later) - col_ref(earlier))


def subset(df: DataFrame, category: str, value: str) -> DataFrame:
    """The rows of one category; operators that take a category group by it instead."""
    return df.filter(col_ref(category) == F.lit(value))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*map(col_ref, columns))
