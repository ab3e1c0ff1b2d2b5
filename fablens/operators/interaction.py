"""Two-way and three-way interactions: what a cell's mean has beyond the main effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_ref, present
from ..plans.vectors import fit_edges, vector_form
from .bins import _binned


def interaction_excess(df: DataFrame, x: str, y: str, target: str, k: int = 5, min_n: int = 5, by: str | None = None) -> DataFrame:
    """(category,) xbin, ybin, n, mean_y, excess, low_support: cell mean less row mean and column mean plus overall mean.

    One aggregate over the rows; the margins are sums over its k * k cells a category.
    """
    keys = ["category"] if by else []
    rows = df.select(*([col_ref(by).alias("category")] if by else []), present(col_ref(x)).alias("x"), present(col_ref(y)).alias("y"), present(col_ref(target)).alias("t")).dropna()
    cells = _binned(rows, keys, {"x": k, "y": k}).groupBy(*keys, F.col("_bin_x").alias("xbin"), F.col("_bin_y").alias("ybin")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("s"))
    return _with_excess(cells, keys).select(*keys, "xbin", "ybin", "n", (F.col("s") / F.col("n")).alias("mean_y"), "excess", (F.col("n") < min_n).alias("low_support"))


def _with_excess(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` (keys, xbin, ybin, n, s) with excess; margins are windows over the cells, k * k of them a key."""

    def mean(*on: str) -> Column:
        over = Window.partitionBy(*keys, *on)
        return F.sum("s").over(over) / F.sum("n").over(over)

    return cells.withColumn("excess", F.col("s") / F.col("n") - mean("xbin") - mean("ybin") + mean())


def interaction_strength(df: DataFrame, candidates: list[tuple[str, str]], target: str, k: int = 5, min_n: int = 5) -> DataFrame:
    """x, y, strength, cells: share-free size of the interaction, the weighted mean square of excess over cells with enough
    rows. Candidate pairs (one at least) are given and make one plan; bins are over each parameter's own values. ``pair_cuts``
    tries all pairs."""
    names = list(dict.fromkeys(c for pair in candidates for c in pair))
    edges = fit_edges(df, names, k, target)
    rows, _ = vector_form(df, edges, target)
    places = F.array(*[F.struct(F.lit(i).alias("pair"), F.get("b", F.lit(names.index(x))).alias("xbin"), F.get("b", F.lit(names.index(y))).alias("ybin")) for i, (x, y) in enumerate(candidates)])
    cells = rows.select("y", F.inline(places)).filter("xbin >= 0 AND ybin >= 0").groupBy("pair", "xbin", "ybin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    told = _with_excess(cells, ["pair"]).filter(F.col("n") >= min_n).groupBy("pair").agg((F.sum(F.col("n") * F.col("excess") * F.col("excess")) / F.sum("n")).alias("strength"), F.count(F.lit(1)).alias("cells"))
    name = lambda i: F.get(F.lit([c[i] for c in candidates]), F.col("pair"))
    return told.select(name(0).alias("x"), name(1).alias("y"), "strength", "cells")


def three_way(df: DataFrame, x: str, y: str, z: str, target: str, k: int = 3, min_n: int = 5) -> DataFrame:
    """xbin, ybin, zbin, n, mean_y, low_support for three given parameters."""
    rows = df.select(present(col_ref(x)).alias("x"), present(col_ref(y)).alias("y"), present(col_ref(z)).alias("z"), present(col_ref(target)).alias("t")).dropna()
    cells = _binned(rows, [], {"x": k, "y": k, "z": k})
    return cells.groupBy(*[F.col(f"_bin_{v}").alias(f"{v}bin") for v in "xyz"]).agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_y")).withColumn("low_support", F.col("n") < min_n)


def pair_cuts(df: DataFrame, params: list[str], target: str, k: int = 8, min_n: int = 5) -> DataFrame:
    """x, y, cut_x, cut_y, n, gain, contrast, rank: for every pair of parameters the cut of both that parts the target best.

    A cut makes four quadrants of at least ``min_n`` rows; ``gain`` is the share of the target's squares that their means save
    over one mean, ``contrast`` what the two high-high and low-low means have beyond the other two. All pairs are one plan:
    rows are counted into k * k cells of each pair, within each task first, and cumulative sums over those cells give all
    (k - 1)² cuts of a pair, so the work beyond one pass over rows * pairs doesn't grow with the rows. Rows that lack one of
    the two values or the target are left out; equal gains (nine digits) go to the least cuts; a pair without a cut has no row.
    """
    edges = fit_edges(df, params, k, target)
    rows, _ = vector_form(df, edges, target)
    conditions = F.filter(F.transform("b", lambda v, p: F.struct(p.alias("p"), v.alias("v"))), lambda c: c["v"] >= 0)
    first = rows.select("y", conditions.alias("c")).select("y", "c", F.explode("c").alias("a"))
    both = first.select("y", "a", F.explode(F.filter("c", lambda c: c["p"] > F.col("a.p"))).alias("b"))
    cells = both.groupBy(F.col("a.p").alias("p"), F.col("b.p").alias("q"), F.col("a.v").alias("v"), F.col("b.v").alias("w"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    # every cell of a pair, also those without rows, so that cumulative sums have no gaps
    listed = cells.groupBy("p", "q").agg(F.sum("ss").alias("ss"), F.map_from_entries(F.collect_list(F.struct(F.col("v") * k + F.col("w"), F.struct("n", "s")))).alias("own"))
    grid = listed.select("p", "q", "ss", "own", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("at"))
    held = F.element_at("own", F.col("at"))
    grid = grid.select("p", "q", "ss", F.floor(F.col("at") / k).cast("int").alias("v"), (F.col("at") % k).alias("w"), F.coalesce(held["n"], F.lit(0)).alias("n"), F.coalesce(held["s"], F.lit(0.0)).alias("s"))
    along, across = Window.partitionBy("p", "q", "v").orderBy("w"), Window.partitionBy("p", "q", "w").orderBy("v")
    for c in ("n", "s"):
        grid = grid.withColumn(c, F.sum(c).over(along))
    for c in ("n", "s"):
        grid = grid.withColumn(c, F.sum(c).over(across))
    row, column, whole = Window.partitionBy("p", "q", "v"), Window.partitionBy("p", "q", "w"), Window.partitionBy("p", "q")
    for c in ("n", "s"):
        edge = lambda on, over, c=c: F.max(F.when(on == k - 1, F.col(c))).over(over)
        grid = grid.withColumn(f"{c}r", edge(F.col("w"), row)).withColumn(f"{c}c", edge(F.col("v"), column))
        grid = grid.withColumn(f"{c}t", F.max(F.when((F.col("v") == k - 1) & (F.col("w") == k - 1), F.col(c))).over(whole))

    def quadrants(c: str) -> list[Column]:
        low, row_, col_, all_ = (F.col(x) for x in (c, f"{c}r", f"{c}c", f"{c}t"))
        return [low, row_ - low, col_ - low, all_ - row_ - col_ + low]

    ns, sums = quadrants("n"), quadrants("s")
    cuts = grid.filter((F.col("v") < k - 1) & (F.col("w") < k - 1) & (F.least(*ns) >= min_n))
    mean = [s / n for n, s in zip(ns, sums, strict=True)]
    saved = sum((s * m for s, m in zip(sums, mean, strict=True)), F.lit(0.0)) - F.col("st") * F.col("st") / F.col("nt")
    total = F.col("ss") - F.col("st") * F.col("st") / F.col("nt")
    gain = F.when(total > 0, F.round(saved / F.nullif(total, F.lit(0.0)), 9))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("v")).alias("v"), (-F.col("w")).alias("w"), F.col("nt").alias("n"), (mean[0] - mean[1] - mean[2] + mean[3]).alias("contrast")))
    best = cuts.filter(gain.isNotNull()).groupBy("p", "q").agg(best.alias("best"))
    name = F.lit(edges.params)

    def cut(p: str, at: str) -> Column:
        lo, width = F.get(F.lit(edges.lo), F.col(p)), F.get(F.lit([(h - a) / k for a, h in zip(edges.lo, edges.hi, strict=True)]), F.col(p))
        return lo + width * (1 - F.col(f"best.{at}"))

    out = best.select(F.get(name, F.col("p")).alias("x"), F.get(name, F.col("q")).alias("y"), cut("p", "v").alias("cut_x"), cut("q", "w").alias("cut_y"), *[F.col(f"best.{c}").alias(c) for c in ("n", "gain", "contrast")])
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "x", "y")))  # over pairs


def interaction_pairs(df: DataFrame, params: list[str], target: str, k: int = 8, min_n: int = 5, among: int | None = None, fitted=None) -> DataFrame:
    """``pair_cuts`` of what main effects leave: pairs ranked by the interaction between them.

    Main effects are an additive model's, fitted here unless given. With ``among``, pairs are only those of that many parameters
    whose main effects are largest, for tables whose pairs are too many; by default all pairs are tried.
    """
    from .model import fit_additive

    fitted = fitted or fit_additive(df, params, target, k=2 * k)
    if among is not None:
        spread = [max(t) - min(t) for t in fitted.shapes]
        params = [c for _, c in sorted(zip(spread, fitted.features, strict=True), reverse=True) if c in params][:among]
    name = "residual"
    while any(c.lower() == name for c in df.columns):
        name += "_"
    left = fitted.predict(df, f"{name}p").withColumn(name, present(col_ref(target)) - F.col(f"{name}p"))
    return pair_cuts(left, params, name, k, min_n)


def three_way_effects(df: DataFrame, triples: list[tuple[str, str, str]], target: str, k: int = 3, min_n: int = 5) -> DataFrame:
    """x, y, z, xbin, ybin, zbin, n, mean_y, excess, low_support: what a cell's mean has beyond all effects of two parameters.

    The excess is the residual of cell means after the best fit, weighted by the cells' rows, of a sum of three functions of two
    parameters each (which hold the main effects). It is reached by taking out weighted means along one axis after another
    until nothing changes, so cells may be as unevenly filled as they are. Cells of fewer than ``min_n`` rows are marked and
    take no part in the fit; their excess is null. All triples are one plan; a task has the k³ sums of one triple at a time.
    """
    import pandas as pd

    names = list(dict.fromkeys(c for t in triples for c in t))
    edges = fit_edges(df, names, k, target)
    rows, mean = vector_form(df, edges, target)
    listed = F.lit([names.index(c) for t in triples for c in t]) if triples else F.array().cast("array<int>")
    held = rows.select("y", "b", F.explode(F.sequence(F.lit(0), F.lit(len(triples) - 1)) if triples else F.array().cast("array<int>")).alias("t"))
    at = [F.get("b", F.get(listed, 3 * F.col("t") + i)) for i in range(3)]
    cells = held.select("t", "y", *[c.alias(f"{v}bin") for c, v in zip(at, "xyz", strict=True)]).filter("xbin >= 0 AND ybin >= 0 AND zbin >= 0")
    cells = cells.groupBy("t", "xbin", "ybin", "zbin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))

    def purified(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = frame.copy()
        place = tuple(f[c].to_numpy() for c in ("xbin", "ybin", "zbin"))
        enough = f["n"].to_numpy() >= min_n
        n, left = np.zeros((k, k, k)), np.zeros((k, k, k))
        n[place], left[place] = np.where(enough, f["n"], 0), np.where(enough, f["m"], 0.0)
        for _ in range(1000):
            most = 0.0
            for axis in range(3):
                total = n.sum(axis=axis, keepdims=True)
                part = np.divide((n * left).sum(axis=axis, keepdims=True), total, out=np.zeros_like(total), where=total > 0)
                left, most = left - part, max(most, float(np.abs(part).max()))
            if most < 1e-10:
                break
        f["excess"] = np.where(enough, left[place], np.nan)
        return f[["t", "xbin", "ybin", "zbin", "n", "m", "excess"]]

    out = cells.groupBy("t").applyInPandas(purified, "t int, xbin int, ybin int, zbin int, n long, m double, excess double")
    who = [F.get(F.lit(names), F.get(listed, 3 * F.col("t") + i)).alias(v) for i, v in enumerate("xyz")]
    return out.select(*who, "xbin", "ybin", "zbin", "n", (F.col("m") + F.lit(mean)).alias("mean_y"), F.when(~F.isnan("excess"), F.col("excess")).alias("excess"), (F.col("n") < min_n).alias("low_support"))
