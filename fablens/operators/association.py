"""Relations between parameters and a target: Pearson, Spearman, lines, process windows (eta squared), thresholds.

All work on the long form, so any number of parameters is one plan; ``by`` adds a category to the key. Pairs are complete
pairs of each parameter. What a constant parameter leaves undefined is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_ref, pearson, present
from ..plans.longform import long_form
from .bins import _binned, running_sums


def pairs(df: DataFrame, params: list[str] | None, target: str, by: str | None = None, held: str | None = None) -> tuple[DataFrame, list[str]]:
    """(category,) param, x, y of complete pairs, and the key columns; and test, if ``held`` names a boolean column."""
    keep, names = ([by, target], ["category", "y"]) if by else ([target], ["y"])
    keys = names[:-1] + ["param"]
    if held:
        keep, names = [*keep, held], [*names, "test"]
    rows = long_form(df, params, keep, names).withColumn("y", present(F.col("y"))).withColumnRenamed("value", "x")
    rows = rows.select(*keys, "x", "y", *(["test"] if held else [F.lit(False).alias("test")]))
    return rows.dropna(subset=["x", "y"]), keys


def centred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with mean_y of their key, and y less that mean: sums of squares of a target far from zero lose its digits."""
    means = rows.groupBy(*keys).agg(F.avg("y").alias("mean_y"))
    return rows.join(F.broadcast(means), keys).withColumn("y", F.col("y") - F.col("mean_y"))


def pearson_summary(df: DataFrame, params: list[str] | None, target: str, by: str | None = None) -> DataFrame:
    """(category,) param, n, r."""
    rows, keys = pairs(df, params, target, by)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r"))


#: Distinct values up to which a parameter's ranks are broadcast.
FEW = 256


def ranks(counts: DataFrame, keys: list[str], value: str, n: str, out: str) -> DataFrame:
    """``counts`` of distinct values with their average-tie ranks less the ranks' mean, which is half a row's number."""
    upto = running_sums(counts, keys, value, {"_upto": n}, {"_all": n})
    return upto.select(*counts.columns, (F.col("_upto") - F.col(n) / 2.0 - F.col("_all") / 2.0).alias(out))


def spearman_summary(df: DataFrame, params: list[str] | None, target: str, by: str | None = None) -> DataFrame:
    """(category,) param, n, rho: Pearson correlation of average ranks.

    Ranks are worked out over distinct values with counts. Rows meet the parameter's ranks only, by broadcast where it has at
    most ``FEW`` values, and are added up by the target's values, which are ranked then.
    """
    rows, keys = pairs(df, params, target, by)
    counts = rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n"))
    own = ranks(counts, keys, "x", "_n", "rx").select(*keys, "x", "rx")
    sizes = counts.groupBy(*keys).agg((F.count(F.lit(1)) <= FEW).alias("few"))
    few, many = (F.broadcast(sizes.filter(c).select(*keys)) for c in ("few", "NOT few"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("rx").alias("s"), F.sum(F.col("rx") * F.col("rx")).alias("xx")]
    met = [rows.join(F.broadcast(own.join(few, keys)), [*keys, "x"]), rows.join(many, keys).join(own.join(many, keys), [*keys, "x"])]
    cells = met[0].select(*keys, "y", "rx").union(met[1].select(*keys, "y", "rx")).groupBy(*keys, "y").agg(*sums)
    each = ranks(cells, keys, "y", "n", "ry")
    both = [F.sum(F.col("s") * F.col("ry")).alias("xy"), F.sum("xx").alias("xx"), F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy")]
    out = each.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), *both)
    return out.select(*keys, "n", (F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("rho"))


def regression_lines(df: DataFrame, params: list[str] | None, target: str, by: str | None = None) -> DataFrame:
    """(category,) param, n, slope, intercept, r2."""
    rows, keys = pairs(df, params, target, by)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"), pearson(F.col("x"), F.col("y")).alias("r"))
    return out.select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (F.col("r") * F.col("r")).alias("r2"))


def monotonic(df: DataFrame, params: list[str] | None, target: str) -> DataFrame:
    """param, r, rho, bent: whether ranks follow the target more closely than values do."""
    both = pearson_summary(df, params, target).select("param", "r").join(spearman_summary(df, params, target).select("param", "rho"), "param")
    return both.withColumn("bent", F.abs("rho") > F.abs("r"))


def eta_squared(df: DataFrame, params: list[str] | None, target: str, k: int = 10, by: str | None = None) -> DataFrame:
    """(category,) param, n, eta2: share of the target's variance between equal-width bins, whatever their order, so a process
    window shows where a correlation is near zero."""
    rows, keys = pairs(df, params, target, by)
    cells = _binned(centred(rows, keys), keys, {"x": k}).groupBy(*keys, "_bin_x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    out = cells.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return out.select(*keys, "n", F.when(F.col("lo") < F.col("hi"), (F.col("between") - mean) / F.nullif(F.col("ss") - mean, F.lit(0.0))).alias("eta2"))


def threshold_split(df: DataFrame, params: list[str] | None, target: str, by: str | None = None, min_side: int = 1) -> DataFrame:
    """(category,) param, cut, gain, mean_low, mean_high: the split x <= cut that lowers the squared error most, its share of
    the total. Learned from the data over distinct values; of equal gains, the least cut."""
    rows, keys = pairs(df, params, target, by)
    cells = centred(rows, keys).groupBy(*keys, "x").agg(F.first("mean_y").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    cells = running_sums(cells.withColumnsRenamed({"n": "n1", "s": "s1", "ss": "ss1"}), keys, "x", {"nl": "n1", "sl": "s1"}, {"n": "n1", "s": "s1", "ss": "ss1"})
    ends = cells.groupBy(*keys).agg((F.min("lo") < F.max("hi")).alias("varies"))
    cells = cells.join(F.broadcast(ends), keys)
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    split = cells.filter(F.col("varies") & (F.col("nl") >= min_side) & (nr >= min_side))  # a constant target has no split
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.nullif(F.col("ss") - mean, F.lit(0.0))
    gain = (F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - mean) / total
    best = split.select(*keys, F.struct(F.round(gain, 9).alias("gain"), (-F.col("x")).alias("minus"), (F.col("m") + F.col("sl") / F.col("nl")).alias("low"), (F.col("m") + sr / nr).alias("high")).alias("b")).groupBy(*keys).agg(F.max("b").alias("b"))
    return best.select(*keys, (-F.col("b.minus")).alias("cut"), F.col("b.gain").alias("gain"), F.col("b.low").alias("mean_low"), F.col("b.high").alias("mean_high"))


def deviation_effect(df: DataFrame, value: str, nominal, target: str) -> DataFrame:
    """r and rho of |value - nominal| with the target."""
    from .derive import with_deviation

    d = with_deviation(df, value, nominal, "deviation")
    return pearson_summary(d, ["deviation"], target).select("param", "n", "r").join(spearman_summary(d, ["deviation"], target).select("param", "rho"), "param")


def abs_and_signed(df: DataFrame, value: str, target: str) -> DataFrame:
    """param (signed, absolute), n, r, rho: whether the sign or the size of a value matters."""
    d = df.select(present(col_ref(value)).alias("signed"), F.abs(present(col_ref(value))).alias("absolute"), present(col_ref(target)).alias("_target"))
    both = ["signed", "absolute"]
    return pearson_summary(d, both, "_target").join(spearman_summary(d, both, "_target").select("param", "rho"), "param")


def discovery(df: DataFrame, params: list[str], target: str, k: int = 10) -> DataFrame:
    """param, n, r, rho, eta2, cut, gain, strength: every measure for all parameters, ranked by the strongest. No p-values: a
    thousand parameters over few rows give chance findings, so use ``stability`` or held-out data before believing one."""
    out = pearson_summary(df, params, target)
    for one in (spearman_summary(df, params, target).select("param", "rho"), eta_squared(df, params, target, k).select("param", "eta2"), threshold_split(df, params, target).select("param", "cut", "gain")):
        out = out.join(one, "param", "left")
    return out.withColumn("strength", F.greatest(F.col("r") * F.col("r"), F.col("rho") * F.col("rho"), "eta2", "gain"))
