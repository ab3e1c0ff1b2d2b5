"""An extension, which no blueprint asks for: windowed target summaries over a stream of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, time: str, category: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, category, n, mean; state of a window is dropped once the watermark has passed it."""
    rows = stream.select(F.col(time).cast("timestamp").alias("ts"), F.col(category).alias("category"), F.col(value).cast("double").alias("x"))
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "category").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "category", "n", "mean")
