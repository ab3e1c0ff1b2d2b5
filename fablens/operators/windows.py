"""Process windows: the range of a parameter within which the target differs most from the rest, by category if asked.

For one parameter, the window is the interval [lo, hi] of its values that lowers the squared error of the target most when
rows inside and outside have a mean each. The target is centred first, so its offset doesn't matter. All intervals between
cells are compared by prefix sums; a cell is a distinct value where a parameter has at most ``cells`` of them, and one of
``cells`` equal-width steps else. In that case the steps at both ends of the best window and their neighbours are opened into
finer ones and searched once more, so its ends are known to about range * 6 / cells², at the same cost for any number of rows.
A task holds at most ``cells`` sums of one parameter and category at a time.

A window is searched on the rows that aren't held out and judged by those that are: ``held_gain`` is the share of their squared
error that the window's two means save over the one mean; ``z`` the difference of their means over its standard error, in the
direction found. ``found`` asks for z >= ``Z``: a thousand parameters without an effect then give about one window by chance.

Defined cases: rows that lack the value, the target or the category are left out; a constant parameter or target has no row;
of equal gains (nine digits) the least lo, then the least hi; without held-out rows z and found are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .association import pairs

CELLS, MIN_SHARE, Z = 256, 0.05, 3.0


def _searched(cells: DataFrame, keys: list[str], kinds: dict[str, str], min_share: float) -> DataFrame:
    """keys, lo, hi, gain (share of the sum of squares) and the cells at both ends, of cells with cell, n, s, lo, hi, total."""
    import pandas as pd

    def best(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = frame.sort_values("cell")
        n, s = np.concatenate([[0], np.cumsum(f["n"].to_numpy())]), np.concatenate([[0], np.cumsum(f["s"].to_numpy())])
        inside, sums = n[None, 1:] - n[:-1, None], s[None, 1:] - s[:-1, None]
        outside = n[-1] - inside
        least = max(1, int(np.ceil(min_share * n[-1])))
        held = np.triu((inside >= least) & (outside >= least))
        total = float(f["total"].iloc[0])
        if not held.any() or not total > 0:
            return pd.DataFrame(columns=names)
        # the centred sum of all is zero but for rounding
        gain = np.where(held, np.round((sums - s[-1] * inside / n[-1]) ** 2 * n[-1] / np.where(held, 1.0 * inside * outside, 1) / total, 9), -1)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        return pd.DataFrame([[*group, f["lo"].iloc[i], f["hi"].iloc[j], gain[i, j], f["cell"].iloc[i], f["cell"].iloc[j]]], columns=names)

    names = [*keys, "lo", "hi", "gain", "cell_lo", "cell_hi"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lo double, hi double, gain double, cell_lo double, cell_hi double"
    return cells.groupBy(*keys).applyInPandas(best, schema)


def process_windows(df: DataFrame, params: list[str] | None, target: str, by: str | None = None, held: str | None = None, cells: int = CELLS, min_share: float = MIN_SHARE) -> DataFrame:
    """(category,) param, n, lo, hi, n_in, mean_in, mean_out, gain, side, held_n, held_gain, z, found.

    ``held`` names a boolean column of held-out rows. ``side`` is "window", or "low"/"high" where the window reaches that end
    of the values, so that it is a threshold. ``min_share`` of a group's rows at least lie inside and outside.
    """
    rows, keys = pairs(df, params, target, by, held)
    rows = rows.withColumn("test", F.coalesce("test", F.lit(False)))
    kinds = dict(rows.dtypes)
    learn = rows.filter("NOT test")
    first = learn.groupBy(*keys).agg(F.avg("y").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), (F.var_pop("y") * F.count(F.lit(1))).alias("total"), F.count(F.lit(1)).alias("rows"))
    values = learn.join(F.broadcast(first), keys).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") - F.col("mean")).alias("s"), *[F.first(c).alias(c) for c in ("min", "max", "total")])
    distinct = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"))
    values = values.join(F.broadcast(distinct), keys)
    step = (F.col("max") - F.col("min")) / cells
    coarse = F.least(F.floor((F.col("x") - F.col("min")) / step).cast("double"), F.lit(cells - 1.0))

    def merged(rows: DataFrame, cell: Column) -> DataFrame:
        return rows.withColumn("cell", cell).groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("total").alias("total"))

    exact = F.col("distinct") <= cells
    varied = values.filter("distinct > 1")
    rough = _searched(merged(varied, F.when(exact, F.col("x")).otherwise(coarse)), keys, kinds, min_share)
    # a second search opens two cells at each end, numbered within by their share of the width
    near = varied.filter(~exact).join(F.broadcast(rough.select(*keys, "cell_lo", "cell_hi")), keys).withColumn("cell", coarse)
    part = max(2, (cells - 3) // 6)  # up to six steps are opened
    place = (F.col("x") - F.col("min")) / step
    opened = (F.abs(F.col("cell") - F.col("cell_lo")) <= 1) | (F.abs(F.col("cell") - F.col("cell_hi")) <= 1)
    core = (F.col("cell") > F.col("cell_lo")) & (F.col("cell") < F.col("cell_hi"))
    fine = F.when(opened, F.floor(place * part) / part).when(core, F.col("cell_lo") + 2).when(F.col("cell") < F.col("cell_lo"), F.lit(-1.0)).otherwise(F.lit(cells + 1.0))
    close = _searched(merged(near, fine), keys, kinds, min_share)
    found = rough.join(distinct, keys).filter(exact).select(*keys, "lo", "hi", "gain").union(close.select(*keys, "lo", "hi", "gain"))
    return _judged(rows, found.join(first, keys), keys)


def _judged(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    y = F.col("y") - F.col("mean")
    each = rows.join(F.broadcast(found), keys).select(*keys, "test", "lo", "hi", "gain", "min", "max", "mean", inside.alias("inside"), y.alias("d"))
    marks = ["lo", "hi", "gain", "min", "max", "mean"]
    parts = {"in": F.col("inside") & ~F.col("test"), "out": ~F.col("inside") & ~F.col("test"), "tin": F.col("inside") & F.col("test"), "tout": ~F.col("inside") & F.col("test")}
    sums = [f(F.when(c, F.col("d"))).alias(f"{k}_{name}") for name, c in parts.items() for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    x = each.groupBy(*keys).agg(*[F.first(m).alias(m) for m in marks], *sums)
    error = lambda c, at: F.when(F.col(f"n_{c}") > 0, F.col(f"n_{c}") * (F.col(f"v_{c}") + (F.col(f"m_{c}") - at) ** 2)).otherwise(0.0)
    saved = 1 - (error("tin", F.col("m_in")) + error("tout", F.col("m_out"))) / F.nullif(error("tin", F.lit(0.0)) + error("tout", F.lit(0.0)), F.lit(0.0))
    spread = F.sqrt(F.col("v_tin") / F.nullif(F.col("n_tin") - 1, F.lit(0)) + F.col("v_tout") / F.nullif(F.col("n_tout") - 1, F.lit(0)))
    z = F.signum(F.col("m_in") - F.col("m_out")) * (F.col("m_tin") - F.col("m_tout")) / F.nullif(spread, F.lit(0.0))
    side = F.when(F.col("lo") <= F.col("min"), "low").when(F.col("hi") >= F.col("max"), "high").otherwise("window")
    return x.select(*keys, (F.col("n_in") + F.col("n_out")).alias("n"), "lo", "hi", "n_in", (F.col("m_in") + F.col("mean")).alias("mean_in"), (F.col("m_out") + F.col("mean")).alias("mean_out"), "gain", side.alias("side"), (F.col("n_tin") + F.col("n_tout")).alias("held_n"), saved.alias("held_gain"), z.alias("z"), (z >= Z).alias("found"))
