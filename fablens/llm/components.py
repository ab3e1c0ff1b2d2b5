"""Connected components of a graph given by links, without gathering any group or link in one place.

Alternating large-star and small-star rounds: each round replaces the links of every node by links to the smallest
neighbour, until links are stars, which one aggregate shows. A node's smallest neighbour comes from an aggregate with a map-side
part; it meets the links in a join whose sides are both plain exchanges, so adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def joinable(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key computed anew, so that a join deals it by an exchange of its own, whose hot partitions can be split."""
    return df.withColumn(key, F.col(key) + F.lit(0))


def _both_ends(links: DataFrame, up: tuple, down: tuple, names: tuple) -> DataFrame:
    """Two rows a link, of one pass over the links."""
    ends = F.array(*(F.struct(*(F.expr(x).alias(n) for x, n in zip(end, names, strict=True))) for end in (up, down)))
    return links.select(F.inline(ends))


def _are_stars(e: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has one only, and no larger one: another round would change nothing."""
    ends = _both_ends(e, ("u", "1L", "0L"), ("v", "0L", "1L"), ("node", "under", "over"))
    seen = ends.groupBy("node").agg(F.sum("under").alias("under"), F.sum("over").alias("over"))
    return seen.agg(F.count_if((F.col("under") > 1) | (F.col("under") > 0) & (F.col("over") > 0))).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach, for each node that has a smaller one in its component.

    Nulls and links of a node to itself are ignored.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = checkpointed(e)
    while not _are_stars(e):
        least = _both_ends(e, ("u", "v"), ("v", "u"), ("u", "v")).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(joinable(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(joinable(least, "u"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
