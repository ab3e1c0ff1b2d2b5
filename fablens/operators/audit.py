"""Data audit: shape, missing values, duplicates, constants, leakage and identifier candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_ref, present
from ..plans.longform import text_form
from .bins import quantiles

NEAR_CONSTANT = 0.99


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def target_exists(df: DataFrame, target: str) -> bool:
    return target in df.columns


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """n, n_missing, mean, std, min, q1, median, q3, max; quartiles are exact."""
    y = present(col_ref(target))
    out = df.agg(F.count(y).alias("n"), F.count_if(y.isNull()).alias("n_missing"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))
    quartiles = quantiles(df.select(y.alias("y")), [], "y", [0.25, 0.5, 0.75])
    both = out.crossJoin(F.broadcast(quartiles))  # one row each
    return both.select("n", "n_missing", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))], "max")


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_missing, share."""
    return text_form(df, columns).groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n")).select("column", "n_missing", (F.col("n_missing") / F.nullif("n", F.lit(0))).alias("share"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_duplicates: rows beyond the first of each set of equal rows."""
    copies = "copies"
    while copies.lower() in {c.lower() for c in df.columns}:
        copies += "_"
    return df.groupBy(*map(col_ref, df.columns)).agg(F.count(F.lit(1)).alias(copies)).agg(F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def _value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_missing, n, n_distinct, top_n. Two levels of aggregation, so a value that most rows hold is combined before it
    is shuffled."""
    counts = text_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    has = F.when(F.col("value").isNotNull(), F.col("_n"))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).cast("long")
    return counts.groupBy("column").agg(missing.alias("n_missing"), F.coalesce(F.sum(has), F.lit(0)).cast("long").alias("n"), F.count(has).alias("n_distinct"), F.coalesce(F.max(has), F.lit(0)).cast("long").alias("top_n"))


def value_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, n_distinct, top_n, top_share over present values."""
    return _value_counts(df, columns).drop("n_missing").withColumn("top_share", F.col("top_n") / F.nullif("n", F.lit(0)))


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return value_shares(df, columns).filter("n_distinct <= 1").select("column", "n_distinct")


def near_constant_columns(df: DataFrame, columns: list[str] | None = None, share: float = NEAR_CONSTANT) -> DataFrame:
    return value_shares(df, columns).filter(F.col("top_share") >= share).select("column", "n_distinct", "top_share")


def kind_counts(df: DataFrame) -> DataFrame:
    """kind, n: from the schema alone."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
    rows = [("numeric", numeric), ("non_numeric", len(df.columns) - numeric)]
    return df.sparkSession.createDataFrame(rows, "kind string, n long")


def columns_present(df: DataFrame, names: list[str]) -> DataFrame:
    """name, present: for leakage lists and for the parameters of a reference document."""
    return df.sparkSession.createDataFrame([(n, n in df.columns) for n in names], "name string, present boolean")


def leakage_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return columns_present(df, names).filter("present").select(F.col("name").alias("column"))


def id_candidates(df: DataFrame, names: list[str] = (), columns: list[str] | None = None, unique_share: float = 0.95) -> DataFrame:
    """column, uniqueness, listed: columns that are listed or whose values are nearly all distinct. Candidates only: nothing
    is excluded for being one."""
    shares = value_shares(df, columns).withColumn("uniqueness", F.col("n_distinct") / F.nullif("n", F.lit(0)))
    listed = F.col("column").isin(*names) if names else F.lit(False)
    return shares.withColumn("listed", listed).filter(F.col("listed") | (F.col("uniqueness") >= unique_share)).select("column", "uniqueness", "listed")


def column_audit(df: DataFrame, leakage: list[str] = (), identifiers: list[str] = ()) -> DataFrame:
    """One row per column, for export: kind, missing values, distinct values, top share, flags."""
    kinds = [(f.name, "numeric" if isinstance(f.dataType, T.NumericType) else "non_numeric", f.name in leakage, f.name in identifiers) for f in df.schema.fields]
    catalogue = df.sparkSession.createDataFrame(kinds, "column string, kind string, leakage boolean, identifier boolean")
    counts = _value_counts(df)  # one pass
    share = F.col("n_missing") / F.nullif(F.col("n_missing") + F.col("n"), F.lit(0))
    counts = counts.select("column", "n_missing", share.alias("share"), "n", "n_distinct", "top_n", (F.col("top_n") / F.nullif("n", F.lit(0))).alias("top_share"))
    return catalogue.join(counts, "column").withColumn("constant", F.col("n_distinct") <= 1).withColumn("near_constant", F.coalesce(F.col("top_share") >= NEAR_CONSTANT, F.lit(False)))
