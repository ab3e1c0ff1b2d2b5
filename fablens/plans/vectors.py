"""The vector form: one row per unit with an array of the parameters' bins, for operators that look at several at once.

Plans have the same size for any number of parameters: edges come from one aggregate over the exploded arrays, a row for each
parameter, and return to the rows as one literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_ref, present


def doubles(numbers: list[float]) -> Column:
    """Numbers as one literal array, parsed at once: thousands of single literals take seconds to make."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in numbers) + ")") if numbers else F.array().cast("array<double>")


def values(params: list[str]) -> Column:
    """The parameters' values as one array; what is not finite is null. One small expression a column keeps plans compilable."""
    return F.transform(F.array(*[col_ref(c).cast("double") for c in params]), present)


@dataclass
class Edges:
    """Equal-width bins 0..k-1 of each parameter; a value beyond them is in the first or last one, a missing one in none (-1)."""

    params: list[str]
    k: int
    lo: list[float]
    hi: list[float]
    mean: float | None = None  # the target's, if they were fitted with one

    def bins(self) -> Column:
        width = [(h - a) / self.k for a, h in zip(self.lo, self.hi, strict=True)]
        above = F.zip_with(values(self.params), doubles(self.lo), lambda x, lo: x - lo)
        inside = lambda d, w: F.greatest(F.lit(0), F.least(F.lit(self.k - 1), F.floor(d / F.nullif(w, F.lit(0.0)))))
        return F.zip_with(above, doubles(width), lambda d, w: F.when(d.isNull(), -1).when(w == 0, 0).otherwise(inside(d, w)).cast("int"))

    def bounds(self, p: int, first: int, last: int | None = None) -> tuple[float, float]:
        """The range of bins first to last of a parameter."""
        width = (self.hi[p] - self.lo[p]) / self.k
        return self.lo[p] + width * first, self.lo[p] + width * ((first if last is None else last) + 1)


def fit_edges(df: DataFrame, params: list[str], k: int, target: str | None = None) -> Edges:
    """Equal-width bins over each parameter's values: one aggregate, two numbers a parameter. (0, 0) where all are missing. The
    target's mean comes from the same pass, if one is named."""
    y = present(col_ref(target)) if target else F.lit(None).cast("double")
    rows = df.select(y.alias("y"), F.posexplode(values(params)).alias("p", "x")).groupBy("p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("y").alias("m")).collect() if params else []
    found = {r.p: (r.lo, r.hi) for r in rows if r.lo is not None}
    ends = [found.get(p, (0.0, 0.0)) for p in range(len(params))]
    return Edges(list(params), k, [e[0] for e in ends], [e[1] for e in ends], (rows[0].m or 0.0) if rows and target else None)


def vector_form(df: DataFrame, edges: Edges, target: str) -> tuple[DataFrame, float]:
    """(y less its mean, b: the bins) of rows that have a target, and that mean (0 without rows)."""
    rows = df.select(present(col_ref(target)).alias("y"), edges.bins().alias("b")).dropna(subset=["y"])
    mean = edges.mean if edges.mean is not None else df.agg(F.avg(present(col_ref(target))).alias("m")).first().m or 0.0
    return rows.withColumn("y", F.col("y") - F.lit(mean)), mean
