"""Ranked contribution tables, trends, parameter tables and insight records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_ref, present


def pareto(df: DataFrame, group: str, amount: str, top: int | None = None) -> DataFrame:
    """group, amount, rank, pct, cum_pct by falling amount, ties by name. A top-k's shares need not total 100.

    Amounts are taken to 13 digits, as the order in which a sum is made changes those behind them: groups of equal amounts
    would be ranked by chance.
    """
    sums = df.groupBy(col_ref(group).cast("string").alias("group")).agg(F.sum(present(col_ref(amount))).alias("amount")).dropna()
    sums = sums.withColumn("amount", F.format_string("%.12e", "amount").cast("double"))
    order = Window.orderBy(F.desc("amount"), "group")  # over groups, not rows
    out = sums.withColumn("rank", F.row_number().over(order)).withColumn("pct", 100 * F.col("amount") / F.nullif(F.sum("amount").over(Window.partitionBy()), F.lit(0.0)))
    out = out.withColumn("cum_pct", F.sum("pct").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter(F.col("rank") <= top) if top else out


def golden_routes(df: DataFrame, group: str, target: str, high: float, top: int | None = None) -> DataFrame:
    """Pareto of groups by their count of units with target >= high."""
    return pareto(df.select(col_ref(group).alias("g"), (present(col_ref(target)) >= high).cast("double").alias("a")), "g", "a", top)


def worsening_routes(df: DataFrame, group: str, target: str, goal: float, top: int | None = None) -> DataFrame:
    """Pareto of groups by their summed loss, the shortfall of the target below the goal."""
    return pareto(df.select(col_ref(group).alias("g"), F.greatest(F.lit(0.0), F.lit(float(goal)) - present(col_ref(target))).alias("a")), "g", "a", top)


def trend_series(df: DataFrame, by: str, seq: str, value: str) -> DataFrame:
    """category, values: the mean of each point of ``seq`` in its order, an array a category; points without a value are left
    out. Means are made before arrays, so an array holds as many numbers as there are points, not rows."""
    points = df.groupBy(col_ref(by).alias("category"), col_ref(seq).alias("seq")).agg(F.avg(present(col_ref(value))).alias("value")).dropna()
    ordered = F.sort_array(F.collect_list(F.struct("seq", "value")))
    return points.groupBy("category").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def trend_points(df: DataFrame, values: str, lo: float = 84.0, hi: float = 96.0, by: str | None = None) -> DataFrame:
    """(category,) label (T1, T2, ...), seq, value, height (0 at hi, 1 at lo) for each element of an array column. The domain
    84 to 96 is a fixed value of the dashboard's charts."""
    keys = [col_ref(by).alias("category")] if by else []
    pos = df.select(*keys, F.posexplode(col_ref(values)).alias("seq", "value"))
    return pos.select(*(["category"] if by else []), F.concat(F.lit("T"), (F.col("seq") + 1).cast("string")).alias("label"), "seq", "value", ((hi - F.col("value")) / (hi - lo)).alias("height"))


def headline(df: DataFrame, value: str, seq: str, by: str | None = None) -> DataFrame:
    """(category,) value of the last point."""
    keys = [col_ref(by).alias("category")] if by else []
    return df.groupBy(*keys).agg(F.max_by(col_ref(value), col_ref(seq)).alias("value"))


def parameter_table(correlations: DataFrame, top: int | None = None) -> DataFrame:
    """param, direction, strength, rank from (param, r), strongest first."""
    rows = correlations.filter("r IS NOT NULL").select("param", F.when(F.col("r") > 0, "Positive").otherwise("Negative").alias("direction"), F.col("r").alias("strength"))
    out = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("strength")), "param")))  # over parameters
    return out.filter(F.col("rank") <= top) if top else out


def _stage(stages: dict[str, str] | None, param: Column) -> Column:
    from itertools import chain

    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in stages.items()))[param] if stages else F.lit(None).cast("string")


def insights(found: DataFrame, stages: dict[str, str] | None = None, windows: DataFrame | None = None) -> DataFrame:
    """param, stage, direction, form, threshold, best_lo, best_hi, strength, text from ``discovery`` rows.

    The best range is that side of ``process_windows``' window (a row a parameter) where the target is higher: the window
    itself, or what lies beyond it if the window touches an end of the values. It is null where the higher side is in two
    pieces, where a window wasn't confirmed by held-out rows, and without windows.
    """
    direction = F.when(F.col("r") > 0, "higher goes with higher").when(F.col("r") < 0, "higher goes with lower")
    form = F.when(F.col("eta2") > 2 * F.col("r") * F.col("r"), "a window or bend").otherwise("a monotonic relation")
    if windows is None:
        found = found.withColumn("best_lo", F.lit(None).cast("double")).withColumn("best_hi", F.lit(None).cast("double"))
    else:
        up, good = F.col("mean_in") > F.col("mean_out"), F.coalesce("found", F.lit(True))
        lo = F.when(up, F.when(F.col("side") != "low", F.col("lo"))).when(F.col("side") == "low", F.col("hi"))
        hi = F.when(up, F.when(F.col("side") != "high", F.col("hi"))).when(F.col("side") == "high", F.col("lo"))
        found = found.join(windows.filter(good).select("param", lo.alias("best_lo"), hi.alias("best_hi")), "param", "left")
    best = F.when(F.col("best_lo").isNotNull() & F.col("best_hi").isNotNull(), F.format_string("; best from %.6g to %.6g", "best_lo", "best_hi")).when(F.col("best_lo").isNotNull(), F.format_string("; best from %.6g on", "best_lo")).when(F.col("best_hi").isNotNull(), F.format_string("; best up to %.6g", "best_hi")).otherwise("")
    text = F.format_string("%s: %s target (r = %.3f), %s; the sharpest change is at %.6g (%.1f %% of variance)", "param", F.coalesce(direction, F.lit("no direction of")), F.coalesce("r", F.lit(0.0)), form, F.coalesce("cut", F.lit(0.0)), 100 * F.coalesce("gain", F.lit(0.0)))
    return found.select("param", _stage(stages, F.col("param")).alias("stage"), direction.alias("direction"), form.alias("form"), F.col("cut").alias("threshold"), "best_lo", "best_hi", "strength", F.concat(text, best).alias("text"))


def combination_insights(found: DataFrame, stages: dict[str, str] | None = None) -> DataFrame:
    """rank, params, stages, direction, n, mean, excess, text from ``subgroups`` rows of two parameters and more."""
    rows = found.filter(F.size("params") > 1)
    direction = F.when(F.col("excess") > 0, "higher").when(F.col("excess") < 0, "lower").otherwise("as high")
    box = F.array_join(F.transform("ranges", lambda c: F.format_string("%s in [%.6g, %.6g)", c["param"], c["lo"], c["hi"])), " and ")
    text = F.format_string("%s: mean target %.6g over %d units, %s by %.6g than the parts alone would have it", box, "mean", "n", direction, F.abs("excess"))
    return rows.select("rank", "params", F.transform("params", lambda p: _stage(stages, p)).alias("stages"), direction.alias("direction"), "n", "mean", "excess", text.alias("text"))
