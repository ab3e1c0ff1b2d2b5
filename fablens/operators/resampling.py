"""How far findings can be trusted: selection under resampling, and error rates over many parameters at once.

Both draw their random numbers from hashes of a key, so a seed gives the same result under any partitioning, rows that share a
key (the wafers of a lot) are drawn together, and all draws are made in one pass after one for means and ends: a row meets a
small array of weights or signs, tasks add up products of such arrays with batches of values, and only their sums by parameter
and draw are shuffled, whose number doesn't grow with the rows.

Defined cases: rows that lack a value or the target count for neither; a constant parameter or target has no measure and is
never selected; a row without a key shares the null key's draws; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_ref, numeric_columns, present
from ..plans.vectors import values

#: Numbers that a task holds of one batch, and of its sums.
HELD = 1 << 22


def _drawn(df: DataFrame, params: list[str] | None, target: str, key: str, draws: Callable[[str], Column], by: str | None) -> tuple[DataFrame, list[str]]:
    """(category,) y, x (the parameters' values), draws of rows that have a target; and the parameters."""
    params = params if params is not None else numeric_columns(df)
    params = [p for p in params if p not in (target, key, by)]
    category = {"category": col_ref(by)} if by else {}
    array = values(params) if params else F.array().cast("array<double>")
    named = {**category, "y": present(col_ref(target)), "x": array, "key": F.coalesce(col_ref(key).cast("string"), F.lit(""))}
    rows = df.select(*[c.alias(n) for n, c in named.items()]).dropna(subset=[*category, "y"])
    return rows.select(*category, "y", "x", draws("key").alias("draws")), params


def _summed(rows: DataFrame, by: str | None, width: int, sums: Callable[..., np.ndarray], k: int = 1) -> DataFrame:
    """(category,) p, sums: for each parameter the arrays of ``width`` numbers that ``sums`` makes of a batch, added up by tasks.

    It takes the values less their mean, the targets less their mean over the parameter's complete pairs (both 0 where a pair
    isn't complete), which pairs are, the values' bins (of ``k`` equal ones), and the draws.
    """
    keys = ["category"] if by else []
    category = dict(rows.dtypes).get("category")
    if by:  # as text, which is the same here and in tasks
        rows = rows.withColumn("category", F.col("category").cast("string"))
    pairs = rows.select(*keys, "y", F.posexplode("x").alias("p", "v")).dropna(subset=["v"])
    stats: dict = {None: {}} if not by else {}  # a few numbers a category and parameter
    for r in pairs.groupBy(*keys, "p").agg(F.avg("v"), F.avg("y"), F.min("v"), F.max("v")).collect():
        stats.setdefault(r[0] if by else None, {})[r.p] = r[-4:]
    n_params = 1 + max((p for of in stats.values() for p in of), default=-1)
    tables = {c: np.array([of.get(p, (0.0, 0.0, 0.0, 0.0)) for p in range(n_params)]).reshape(-1, 4).T for c, of in stats.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def told() -> Iterator[pa.RecordBatch]:
            for c, of in held.items():
                own = [pa.array([c] * n_params)] if by else []
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(n_params), pa.int32()), pa.array(list(of), pa.list_(pa.float64()))], names=[*keys, "p", "sums"])
            held.clear()

        for whole in batches:
            n_draws = len(whole.column("draws")[0]) if whole.num_rows else 0
            step = max(1, HELD // (n_params * width // max(1, n_draws) + n_params + n_draws + 1))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                of = np.array([tables_at.get(c, -1) for c in batch.column(0).to_pylist()]) if by else np.zeros(batch.num_rows, int)
                y = batch.column("y").to_numpy()
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :n_params]
                w = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for i in np.unique(of):
                    if i < 0:  # a category without a complete pair
                        continue
                    c, on = names[i], of == i
                    mx, my, lo, hi = tables[c]
                    v = x[on]
                    there = ~np.isnan(v)
                    bins = np.minimum(np.floor(np.where(there & (hi > lo), (v - lo) / np.where(hi > lo, (hi - lo) / k, 1), 0)), k - 1)
                    found = sums(np.where(there, v - mx, 0), np.where(there, y[on, None] - my, 0), there, bins, w[on])
                    held[c] = held[c] + found if c in held else found
                if len(held) * n_params * width > HELD:
                    yield from told()
        yield from told()

    names = list(tables)
    tables_at = {c: i for i, c in enumerate(names)}
    told = rows.mapInArrow(run, ("category string, " if by else "") + "p int, sums array<double>")
    return told.withColumn("category", F.col("category").cast(category)) if by else told


def poisson_weights(draws: int, seed: int):
    """For each draw how often a key's rows count: Poisson with mean one, as in a bootstrap of many rows."""
    upto = poisson_steps()

    def weights(key: str) -> Column:
        return F.transform(hashes(draws, seed)(key), lambda h: sum((F.when(F.pmod(h, F.lit(1 << 40)) >= int(x), 1).otherwise(0) for x in upto), F.lit(0)))

    return weights


def poisson_steps() -> np.ndarray:
    """Of a whole number below 2^40, from where on it counts once more."""
    return np.ceil(np.cumsum([exp(-1) / factorial(n) for n in range(8)]) * (1 << 40)).astype(np.int64)


def hashes(draws: int, seed: int):
    """For each draw a key's hash."""
    return lambda key: F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.xxhash64(F.col(key), i, F.lit(seed)))


def stability_selection(df: DataFrame, params: list[str] | None, target: str, key: str, top: int, draws: int = 50, k: int = 10, seed: int = 0) -> DataFrame:
    """param, measure (r or eta2), mean, std, frequency, same_sign over bootstrap draws of keys.

    ``frequency`` is the share of draws in which the parameter is among the ``top`` strongest by the measure (equal strengths,
    to nine digits, by name); ``same_sign`` whether r has one sign in all draws (null for eta2).
    """
    rows, params = _drawn(df, params, target, key, hashes(draws, seed), None)
    names, upto = ["n", "sx", "sy", "xx", "xy", "yy"], poisson_steps()

    def sums(x: np.ndarray, y: np.ndarray, there: np.ndarray, bins: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = np.searchsorted(upto, w & (1 << 40) - 1, "right").astype(float)  # poisson_weights
        every = []
        for p in range(x.shape[1]):
            on = (bins[:, p, None] == np.arange(k)) & there[:, p, None]
            columns = [there[:, p], x[:, p], y[:, p], x[:, p] * x[:, p], x[:, p] * y[:, p], y[:, p] * y[:, p]]
            every.append((w.T @ np.column_stack([*columns, on, on * y[:, p, None]])).ravel())
        return np.array(every)

    width = len(names) + 2 * k
    each = _summed(rows, None, draws * width, sums, k).select("p", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "sums")
    at = lambda i: F.sum(F.get("sums", F.col("draw") * width + i))
    each = each.groupBy("p", "draw").agg(*[at(i).alias(c) for i, c in enumerate(names)], F.array(*[at(6 + i) for i in range(k)]).alias("bn"), F.array(*[at(6 + k + i) for i in range(k)]).alias("by"))
    between = F.aggregate(F.zip_with("bn", "by", lambda n, s: F.when(n > 0, s * s / n).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    each = each.filter("n > 0").select(F.get(F.lit(params), F.col("p")).alias("param"), "draw", *names, between.alias("between"))
    n, sx, sy = (F.col(c) for c in ("n", "sx", "sy"))
    vx, vy = F.col("xx") - sx * sx / n, F.col("yy") - sy * sy / n
    small = lambda v, whole: v > 1e-12 * whole
    r = F.when(small(vx, F.col("xx")) & small(vy, F.col("yy")), (F.col("xy") - sx * sy / n) / F.sqrt(vx * vy))
    eta = F.when(small(vx, F.col("xx")) & small(vy, F.col("yy")), (F.col("between") - sy * sy / n) / vy)
    told = each.select("param", "draw", F.explode(F.map_from_arrays(F.array(F.lit("r"), F.lit("eta2")), F.array(r, eta))).alias("measure", "value"))
    order = Window.partitionBy("draw", "measure").orderBy(F.desc(F.round(F.abs("value"), 9)), "param")  # over parameters
    told = told.filter(F.col("value").isNotNull()).withColumn("chosen", F.row_number().over(order) <= top)
    same = F.when(F.col("measure") == "r", F.abs(F.sum(F.signum("value"))) == F.count("value"))
    return told.groupBy("param", "measure").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.count_if("chosen") / F.lit(draws)).alias("frequency"), same.alias("same_sign"))


def max_statistic_test(df: DataFrame, params: list[str] | None, target: str, key: str, draws: int = 199, seed: int = 0, by: str | None = None) -> DataFrame:
    """(category,) param, n, r, statistic, p_single, p_adjusted: linear relations with an error rate over all parameters.

    The statistic is |sum of z| / sqrt(sum of z²) with z the product of the centred value and target. Under no relation z is as
    likely one way as the other, so each draw turns the signs of z at random, all parameters of a key alike, and the largest
    statistic of any parameter in a draw is kept. ``p_adjusted`` is the share of draws whose largest reaches the parameter's own
    (the observed one counted in), so the chance of any false finding below 0.05 is about 0.05, however many parameters are
    related to each other; ``p_single`` compares with the parameter's own draws. Turning signs needs no rows to change places,
    as permuting the target would.
    """
    rows, params = _drawn(df, params, target, key, hashes(draws, seed), by)
    own = ["n", "z", "zz", "x", "y", "xx", "yy"]

    def sums(x: np.ndarray, y: np.ndarray, there: np.ndarray, bins: np.ndarray, w: np.ndarray) -> np.ndarray:
        z, w = x * y, 2.0 * (w & 1) - 1
        return np.vstack([w.T @ z, *[v.sum(axis=0) for v in (there, z, z * z, x, y, x * x, y * y)]]).T

    group = ["category"] if by else []
    keys = [*group, "param"]
    named = _summed(rows, by, draws + len(own), sums).select(*group, F.get(F.lit(params), F.col("p")).alias("param"), F.posexplode("sums").alias("at", "s"))
    added = named.groupBy(*keys, "at").agg(F.sum("s").alias("s")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda v: v["s"]).alias("s"))  # draws and a few numbers
    got = {c: F.get("s", F.lit(draws + i)) for i, c in enumerate(own)}
    n = got["n"]
    inside = lambda c: F.when(got[c + c] - got[c] * got[c] / n > 1e-12 * got[c + c], got[c + c] - got[c] * got[c] / n)
    r = (got["z"] - got["x"] * got["y"] / n) / F.sqrt(inside("x") * inside("y"))
    told = added.filter(n > 0).select(*keys, n.cast("long").alias("n"), r.alias("r"), F.sqrt(got["zz"]).alias("size"), F.abs(got["z"]).alias("sum"), F.slice("s", 1, draws).alias("s")).filter("r IS NOT NULL AND size > 0")
    told = told.select(*keys, "n", "r", (F.col("sum") / F.col("size")).alias("statistic"), F.posexplode(F.transform("s", lambda v: F.abs(v) / F.col("size"))).alias("draw", "chance"))
    told = told.withColumn("largest", F.max("chance").over(Window.partitionBy(*group, "draw")))  # over parameters
    reached = lambda c: (1 + F.count_if(F.col(c) >= F.col("statistic") - 1e-9)) / F.lit(float(draws + 1))
    return told.groupBy(*keys, "n", "r", "statistic").agg(reached("chance").alias("p_single"), reached("largest").alias("p_adjusted"))
