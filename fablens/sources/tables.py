"""Sources and sinks: wafer tables in, audits, features and plot data out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_ref


def read_wafers(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with a header. With a schema there is no pass to infer one; blanks and NaN are null."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("nullValue", "")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[F.when(~F.isnan(col_ref(c)), col_ref(c)).alias(c) if c in floats else col_ref(c) for c in df.columns])


def read_records(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline records, such as a dashboard's."""
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """Column audits, heatmap cells, plot data, feature lists."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_features(screened: DataFrame, folder: str) -> None:
    """included_features and excluded_features, the latter with reasons."""
    from ..operators.screening import excluded, included

    write_csv(included(screened), f"{folder}/included_features.csv")
    write_csv(excluded(screened), f"{folder}/excluded_features.csv")


def read_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as units: a line item with its part and order. The only joins of this library's analysis side."""
    at = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line, part, orders = at("lineitem"), at("part"), at("orders")
    return line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
