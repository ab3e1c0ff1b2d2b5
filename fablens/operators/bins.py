"""Histograms, box plots, binned responses and heatmaps.

Bin edges come from a one-row aggregate (one row per group) that is joined back, so the whole operator is one lazy plan.
That side has one row a parameter and category and is broadcast, as a shuffle by so few keys would bring all rows of a key into
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, col_ref, present
from ..plans.longform import long_form

LOW_SUPPORT = 5


def _edges(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    stats = [f(v).alias(f"_{e}_{v}") for v in values for e, f in (("lo", F.min), ("hi", F.max))]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*stats)))
    return df.join(F.broadcast(df.groupBy(*by).agg(*stats)), by)


def _binned(df: DataFrame, by: list[str], values: dict[str, int]) -> DataFrame:
    """``df`` (by, values, ...) with _bin_<value>; rows without a value are dropped."""
    df = df.dropna(subset=[*by, *values])
    df = _edges(df, by, list(values))
    for v, k in values.items():
        df = df.withColumn(f"_bin_{v}", bucket(F.col(v), F.col(f"_lo_{v}"), F.col(f"_hi_{v}"), k))
    return df


def _bounds(v: str, k: int, bin_: str) -> list:
    lo, hi = F.min(f"_lo_{v}"), F.max(f"_hi_{v}")
    width = (hi - lo) / k
    return [(lo + width * F.col(bin_)).alias("lo"), (lo + width * (F.col(bin_) + 1)).alias("hi")]


#: Ranges that a parameter's values are dealt into for running sums.
PARTS = 64


def running_sums(cells: DataFrame, keys: list[str], value: str, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """``cells`` with running sums in the order of ``value`` within keys: sums maps new columns to summed ones, totals likewise
    for the sums over all of a key.

    Values are dealt into PARTS equal ranges of a key, so a window's task sorts one range; what lies before a range is the sum
    of the ranges' totals, PARTS rows a key. Results don't depend on how evenly ranges are filled.
    """
    totals = totals or {}
    part = "_bin_" + value
    dealt = _binned(cells, keys, {value: PARTS})
    own = list(dict.fromkeys([*sums.values(), *totals.values()]))
    ranges = dealt.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_{c}") for c in own])
    before, all_ = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranges = ranges.select(*keys, part, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{o}") for o, c in sums.items()], *[F.sum(f"_{c}").over(all_).alias(o) for o, c in totals.items()])
    within = Window.partitionBy(*keys, part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select(*cells.columns, part, *[F.sum(c).over(within).alias(f"_within_{o}") for o, c in sums.items()])
    return local.join(F.broadcast(ranges), [*keys, part]).select(*cells.columns, *[(F.col(f"_before_{o}") + F.col(f"_within_{o}")).alias(o) for o in sums], *totals)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, q: the exact quantiles of a value, between two neighbours in proportion. Null where a key has no value.

    They are read off running counts of distinct values, so no task holds all values of a key, as an aggregate would.
    """
    counts = rows.select(*keys, F.col(value).alias("_v")).dropna(subset=["_v", *keys]).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, keys, "_v", {"_upto": "_n"}, {"_all": "_n"})

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_v")))

    places = [F.lit(float(p)) * (F.col("_all") - 1) for p in shares]
    picked = [f(p).alias(f"_{n}{i}") for i, p in enumerate(places) for n, f in (("lo", lambda p: at(F.floor(p))), ("hi", lambda p: at(F.ceil(p))), ("part", lambda p: F.first(p - F.floor(p))))]
    found = run.groupBy(*keys).agg(*picked)
    return found.select(*keys, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(shares))]).alias("q"))


def histogram(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """bin, lo, hi, n: exact equal-width counts; empty bins have no row."""
    x = _binned(df.select(present(col_ref(value)).alias("x")), [], {"x": k}).withColumnRenamed("_bin_x", "bin")
    return x.groupBy("bin").agg(*_bounds("x", k, "bin"), F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by..., n, q1, median, q3, whisker_lo, whisker_hi, n_outliers; whiskers are the outermost values within 1.5 IQR."""
    by = list(by)
    x = df.select(*[col_ref(c).alias(c) for c in by], present(col_ref(value)).alias("x")).dropna(subset=["x"])
    quart = quantiles(x, by, "x", [0.25, 0.5, 0.75])
    quart = quart.select(*by, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    joined = x.join(F.broadcast(quart), by) if by else x.crossJoin(F.broadcast(quart))  # a row a group
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    keys = [*by, "q1", "median", "q3"]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("x"))).alias("whisker_lo"), F.max(F.when(inside, F.col("x"))).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))


def distributions(df: DataFrame, params: list[str], k: int = 10) -> DataFrame:
    """param, bin, lo, hi, n."""
    x = _binned(long_form(df, params), ["param"], {"value": k}).withColumnRenamed("_bin_value", "bin")
    return x.groupBy("param", "bin").agg(*_bounds("value", k, "bin"), F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y of complete rows."""
    return df.select(present(col_ref(x)).alias("x"), present(col_ref(y)).alias("y")).dropna()


def binned(df: DataFrame, params: list[str], target: str, k: int = 10, by: str | None = None) -> DataFrame:
    """(category,) param, bin, lo, hi, n, mean_y over equal-width bins; with ``by``, bins are those of each category."""
    keep, names = ([by, target], ["category", "_y"]) if by else ([target], ["_y"])
    x = long_form(df, params, keep, names).withColumn("_y", present(F.col("_y")))
    keys = names[:-1] + ["param"]
    x = _binned(x.select(*keys, "value", "_y"), keys, {"value": k}).withColumnRenamed("_bin_value", "bin")
    return x.groupBy(*keys, "bin").agg(*_bounds("value", k, "bin"), F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean_y"))


def binned_quantile(df: DataFrame, param: str, target: str, k: int = 10) -> DataFrame:
    """bin, lo, hi, n, mean_y over quantile bins. A value's bin follows from its exact rank among distinct values' counts, so
    equal values are in one bin and the sort is over distinct values."""
    rows = df.select(present(col_ref(param)).alias("x"), present(col_ref(target)).alias("y")).dropna(subset=["x"])
    per = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("ny"), F.sum("y").alias("sy"))
    ranked = running_sums(per, [], "x", {"upto": "n"}, {"all": "n"})
    ranked = ranked.withColumn("bin", F.floor((F.col("upto") - F.col("n")) * k / F.col("all")).cast("int"))
    return ranked.groupBy("bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").cast("long").alias("n"), (F.sum("sy") / F.nullif(F.sum("ny"), F.lit(0))).alias("mean_y"))


def heatmap(df: DataFrame, x: str, y: str, target: str, kx: int = 5, ky: int = 5, by: str | None = None, min_n: int = LOW_SUPPORT) -> DataFrame:
    """(category,) xbin, ybin, n, mean_y, low_support: mean and count of a cell in one aggregate; no cell is dropped for its
    count. With ``by``, bins are those of each category, and categories are never mixed."""
    keys = ["category"] if by else []
    rows = df.select(*([col_ref(by).alias("category")] if by else []), present(col_ref(x)).alias("x"), present(col_ref(y)).alias("y"), present(col_ref(target)).alias("_t"))
    rows = _binned(rows, keys, {"x": kx, "y": ky}).withColumnsRenamed({"_bin_x": "xbin", "_bin_y": "ybin"})
    return rows.groupBy(*keys, "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"), F.avg("_t").alias("mean_y")).withColumn("low_support", F.col("n") < min_n)


def summary_by(df: DataFrame, category: str, target: str) -> DataFrame:
    """category, n, mean, std, min, median, max."""
    named = col_ref(category)
    rows = df.select(named.alias("category"), F.coalesce(named.cast("string"), F.lit("")).alias("_k"), named.isNull().alias("_none"), present(col_ref(target)).alias("y"))
    keys = ["_k", "_none"]  # a null category is one too
    out = rows.groupBy("category", *keys).agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"))
    middle = quantiles(rows, keys, "y", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("median"))
    return out.join(middle, keys, "left").select("category", "n", "mean", "std", "min", "median", "max")
