"""Which ranges of which parameters together go along with an unusual target: exact search for the best subgroups.

A condition is a range of neighbouring bins of one parameter (not all of them), a subgroup the rows that meet conditions on
up to ``depth`` parameters. Its quality is sqrt(n) * |mean - overall mean|. No part of a subgroup can exceed the root of the
sum of its squared deviations above the mean, or of those below it, whichever is larger; nor can a part have more rows. So a
condition or combination whose bound is below the ``top``-th best quality so far, or with fewer than ``min_n`` rows, is left
out with all that would extend it, and the result is the same as if all were tried.

Rows are looked at once a level, as the cells (bins of each parameter) they lie in; ranges are then sums over cells, of which
there are at most k ** depth for a set of parameters, whatever the number of rows. A level makes a row for each set of
parameters whose cells may still matter, summed within each task. The driver sees one number a level.

Defined cases: rows without a target are left out, rows without a parameter are in none of its ranges; a constant target
gives no row; of equal qualities (nine digits) the fewest rows, then the least ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.vectors import fit_edges, vector_form

SUMS = ("n", "s", "up", "down")


def _quality() -> Column:
    return F.round(F.abs(F.col("s")) / F.sqrt(F.col("n")), 9)


def _bound() -> Column:
    return F.sqrt(F.greatest("up", "down")) * (1 + 1e-9) + 1e-9


def _beyond(last: str) -> Column:
    return F.filter("c", lambda c: c["p"] > F.col(f"{last}.p"))


def subgroups(df: DataFrame, params: list[str], target: str, k: int = 5, depth: int = 2, top: int = 20, min_n: int = 20) -> DataFrame:
    """rank, params, ranges (param, lo, hi), n, mean, quality, excess: for each of the best ``top`` sets of parameters its best
    ranges. ``excess`` is what the mean has beyond the overall mean and the sum of what each range has alone."""
    edges = fit_edges(df, params, k, target)
    rows, mean = vector_form(df, edges, target)
    spark = df.sparkSession
    ranges = spark.range(k).select(F.col("id").cast("int").alias("a")).select("a", F.explode(F.sequence("a", F.lit(k - 1))).alias("z")).filter(F.col("z") - F.col("a") < k - 1)
    conditions = F.filter(F.transform("b", lambda v, p: F.struct(p.alias("p"), v.alias("v"))), lambda c: c["v"] >= 0)
    held = rows.select("y", conditions.alias("c"))
    y2 = F.col("y") * F.col("y")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.when(F.col("y") > 0, y2).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("y") < 0, y2).otherwise(0.0)).alias("down")]
    added = [F.sum(c).alias(c) for c in SUMS]
    best, alone, found, live = None, None, [], None
    for d in range(1, depth + 1):
        names = [f"{x}{i}" for i in range(d) for x in ("p", "v")]
        paths = held.withColumn("c0", F.explode("c"))
        for i in range(1, d):
            paths = paths.withColumn(f"c{i}", F.explode(_beyond(f"c{i - 1}")))
        cells = paths.select("y", *[F.col(f"c{i}.{x}").alias(f"{x}{i}") for i in range(d) for x in ("p", "v")])
        if live is not None:  # every subset of d - 1 cells still matters
            for out in range(d):
                kept = [i for i in range(d) if i != out]
                on = [F.col(f"{x}{i}") == F.col(f"_{x}{j}") for j, i in enumerate(kept) for x in ("p", "v")]
                cells = cells.join(live.select(*[F.col(f"{x}{j}").alias(f"_{x}{j}") for j in range(d - 1) for x in ("p", "v")]), on, "left_semi")
        cells = cells.groupBy(*names).agg(*sums)
        for i in range(d):
            step = ranges.select(F.col("a").alias(f"a{i}"), F.col("z").alias(f"z{i}"))
            cells = cells.join(F.broadcast(step), (F.col(f"v{i}") >= F.col(f"a{i}")) & (F.col(f"v{i}") <= F.col(f"z{i}")))  # at most k² ranges
            keys = [*[f"{x}{j}" for j in range(i + 1) for x in ("p", "a", "z")], *[f"{x}{j}" for j in range(i + 1, d) for x in ("p", "v")]]
            cells = cells.groupBy(*keys).agg(*added)
        boxes = cells.filter(F.col("n") >= min_n).withColumn("quality", _quality()).withColumn("bound", _bound()).persist()
        ps, ends = [f"p{i}" for i in range(d)], [f"{x}{i}" for i in range(d) for x in ("a", "z")]
        order = Window.partitionBy(*ps).orderBy(F.desc("quality"), "n", *ends)
        lead = boxes.withColumn("at", F.row_number().over(order)).filter("at = 1 AND quality > 0")
        alone = boxes if d == 1 else alone
        box = F.array(*[F.struct(*[F.col(f"{x}{i}").alias(x) for x in ("p", "a", "z")]) for i in range(d)])
        lead = lead.select(box.alias("box"), "n", "s", "quality")
        found.append(lead)
        best = lead if best is None else best.union(lead)
        bar = best.orderBy(F.desc("quality")).limit(top).agg(F.min("quality").alias("bar"), F.count(F.lit(1)).alias("n")).first()
        least = bar.bar if bar.n == top else 0.0
        # cells of ranges that may still lead to a better subgroup
        live = boxes.filter(F.col("bound") >= least)
        for i in range(d):
            live = live.withColumn(f"v{i}", F.explode(F.sequence(F.col(f"a{i}"), F.col(f"z{i}"))))
        live = live.select(*names).distinct()
    singles = alone.select(F.struct(F.col("p0").alias("p"), F.col("a0").alias("a"), F.col("z0").alias("z")).alias("c"), (F.col("s") / F.col("n")).alias("own"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("quality"), F.size("box"), "box"))).filter(F.col("rank") <= top)  # a row a set of parameters
    parts = ranked.select("rank", F.explode("box").alias("c")).join(singles, "c").groupBy("rank").agg(F.sum("own").alias("own"))
    name, lo = F.lit(edges.params), F.lit(edges.lo)
    width = F.lit([(h - a) / k for a, h in zip(edges.lo, edges.hi, strict=True)])
    at = lambda c, p: F.element_at(c, p + 1)
    shown = F.transform("box", lambda c: F.struct(at(name, c["p"]).alias("param"), (at(lo, c["p"]) + at(width, c["p"]) * c["a"]).alias("lo"), (at(lo, c["p"]) + at(width, c["p"]) * (c["z"] + 1)).alias("hi")))
    return ranked.join(parts, "rank").select("rank", F.transform(shown, lambda c: c["param"]).alias("params"), shown.alias("ranges"), "n", (F.col("s") / F.col("n") + F.lit(mean)).alias("mean"), "quality", (F.col("s") / F.col("n") - F.col("own")).alias("excess"))
