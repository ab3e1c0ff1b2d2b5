"""Embedding near-dedup with a pivot-permutation index.

A vector is described by the ordered numbers of its nearest reference points (pivots): ``NEAREST`` of them, or as many more as
bring ``RECALL`` of trial pairs at the threshold together (sampled vectors and random turns of them), up to ``MOST_NEAREST``.
Two vectors are compared if they share at least two pivots. The inverted lists are kept by pairs of pivots, so a list holds just the vectors that
share both, and two vectors are compared in the list of their two smallest shared pivots only. The comparison is the cosine
in double precision, so links below the threshold are never returned; the index may miss a link, and its recall is measured
against brute force in the tests.

There is a pivot for every ``PER_PIVOT`` vectors, from ``LEAST_PIVOTS`` up to ``PIVOTS`` and to ``PIVOT_BYTES`` bytes of them,
chosen from a bounded sample of twice as many vectors so that no two are alike (less than the first of ``SPREADS`` that leaves
enough of them), hence a large group of near copies does not take them up. Every length of vector has pivots of its own. A
list of more than ``BLOCK`` vectors is cut into blocks, and pairs of blocks are compared in separate tasks, so no list is ever
in one task. A comparison returns a row for each of its vectors that has links: their number, and one that it is connected to.
So links of a large group are counted, but never listed. Equal vectors are one class with a count and enter the index once.

Defined cases: a vector that is null, empty or zero or holds null or non-finite components links with nothing; vectors of
different lengths don't link; components are doubles of any size; every input row gives one output row, so repeated rows link
with one another; a null id has no component and takes part in no link; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, ship, table
from .components import components, joinable

THRESHOLD = 0.9
NEAREST, MOST_NEAREST, RECALL = 8, 24, 0.95
PER_PIVOT, LEAST_PIVOTS, PIVOTS, PIVOT_BYTES = 20, 256, 16384, 64 << 20
SPREADS = (0.7, 0.8, 0.9, 0.95, 0.99, 0.999)
BLOCK = 2048


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the largest and smallest doubles are no doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vector: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def spread_points(points: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` of the unit vectors, in their order, so that no two are alike."""
    kept = points[:0]
    for spread in SPREADS:
        kept = points[:1]
        for at in range(1, len(points), 256):
            some = points[at : at + 256]
            some = some[(some @ kept.T < spread).all(1)]
            alike = some @ some.T >= spread
            free = np.ones(len(some), bool)
            for i in range(len(some)):
                if free[i]:
                    free[i + 1 :] &= ~alike[i, i + 1 :]
            kept = np.concatenate([kept, some[free]])[:wanted]
            if len(kept) == wanted:
                return kept
        if len(kept) >= min(wanted, len(points)) / 4:
            break
    return kept


def nearest_pivots(vec: np.ndarray, points: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of unit vectors, in order; of equally near ones the smaller number first."""
    near = [np.zeros((0, min(nearest, len(points))), np.int32)]
    for at in range(0, len(vec), 256):
        like = -(vec[at : at + 256] @ points.T)
        top = np.argpartition(like, nearest - 1, axis=1)[:, :nearest] if like.shape[1] > nearest else np.tile(np.arange(like.shape[1]), (len(like), 1))
        order = np.lexsort((top, np.take_along_axis(like, top, 1)))
        near.append(np.take_along_axis(top, order, 1).astype(np.int32))
    return np.concatenate(near)


def enough_nearest(sample: np.ndarray, points: np.ndarray, threshold: float, least: int = NEAREST) -> int:
    """How many nearest pivots bring trial pairs together."""
    a = sample[:512]
    turn = np.random.default_rng(3).normal(size=a.shape)
    turn -= (turn * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(turn, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * np.divide(turn, size, out=np.zeros_like(turn), where=size > 0)
    x, y = nearest_pivots(a, points, MOST_NEAREST), nearest_pivots(b, points, MOST_NEAREST)
    for n in range(least, MOST_NEAREST, 2):
        if ((x[:, :n, None] == y[:, None, :n]).sum((1, 2)) >= 2).mean() >= RECALL:
            return n
    return MOST_NEAREST


def choose_pivots(vectors: DataFrame, per_pivot: int = PER_PIVOT, pivots: int = PIVOTS, threshold: float = THRESHOLD) -> dict[int, tuple[np.ndarray, int]]:
    """length of vector -> its pivots and how many nearest ones to name, from a sample by the hash of the ids, twice as large
    as the pivots wanted."""
    sized = vectors.select("id", "vector", F.size("vector").alias("dim"))
    counts = {r["dim"]: r["count"] for r in sized.groupBy("dim").count().filter("count > 1").collect()}  # a row for each length
    if not counts:
        return {}
    whole = sum(counts.values())
    wanted = {d: max(2, min(max(LEAST_PIVOTS, n // per_pivot), pivots, PIVOT_BYTES // (8 * d), -(-pivots * n // whole) + LEAST_PIVOTS)) for d, n in counts.items()}
    wide = 1 << 30
    rates = vectors.sparkSession.createDataFrame([(d, max(1, min(wide, wide * 2 * wanted[d] // n + wide * 64 // n))) for d, n in counts.items()], "dim int, most long")
    picked = sized.join(F.broadcast(rates), "dim").filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(wide)) < F.col("most"))
    rows = picked.select("dim", "vector", F.xxhash64("id", F.lit(4)).alias("place"), "id").toPandas().sort_values(["place", "id"])
    out = {}
    for d, part in rows.groupby("dim"):
        sample = _unit(np.stack(part["vector"].to_numpy()))
        points = spread_points(sample, wanted[d])
        out[int(d)] = points, enough_nearest(sample, points, threshold)
    return out


def pivot_index(vectors: DataFrame, points: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """id, copies, vector, dim, near: the numbers of the nearest pivots, in order. Lengths without pivots have no row."""
    shared = vectors.sparkSession.sparkContext.broadcast(points)  # PIVOT_BYTES for a length at most
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            for dim in np.unique(sizes):
                if int(dim) not in shared.value:
                    continue
                of = batch.filter(pa.array(sizes == dim))
                near = nearest_pivots(_unit(_matrix(of.column(2), dim)), *shared.value[int(dim)])
                yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), of.column(2), pa.array(np.full(len(near), dim, np.int32)), pa.array(list(near), pa.list_(pa.int32()))], names=["id", "copies", "vector", "dim", "near"])

    return vectors.select("id", "copies", "vector").mapInArrow(run, f"id long, copies long, vector {kind}, dim int, near array<int>")


def links(index: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b, others: for each vector a of a comparison that has links there, how many (copies counted), and the smallest id
    that they connect it with."""
    pairs = F.expr("""transform(sequence(0, greatest(size(near) - 2, 0)), i -> transform(sequence(least(i + 1, size(near) - 1), size(near) - 1),
        j -> struct(least(near[i], near[j]) AS p, greatest(near[i], near[j]) AS q)))""")
    entry = index.select("id", "copies", "vector", "dim", "near", F.explode(F.flatten(pairs)).alias("key")).select("id", "copies", "vector", "dim", "near", "key.*")
    sizes = index.select("dim", F.explode(F.flatten(pairs)).alias("key")).groupBy("dim", "key.p", "key.q").agg(F.count("*").alias("n"))
    # a list of one compares nothing
    cut = sizes.filter("n > 1").select("dim", "p", "q", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    for key in ("dim", "p", "q"):
        cut = joinable(cut, key)
    entry = entry.join(cut, ["dim", "p", "q"])
    entry = entry.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    entry = entry.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = entry.select("dim", "p", "q", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "copies", "vector", "near", "block")

    def compare(rows: list) -> pa.RecordBatch | None:
        _, p, q, lo, hi = rows[0][:5]
        ids, copies, vec, near, of = (np.concatenate([r[i] for r in rows]) for i in range(5, 10))
        # pivots below q other than p: two vectors that share one of those are compared elsewhere
        below = np.sort(np.where((near < q) & (near != p), near, -1), axis=1)
        kinds, kind = np.unique(below, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        left = of == lo
        right = left if lo == hi else of == hi
        vec, label, degree = _unit(vec), np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for g in np.unique(kind[left]):
            mine, clash = kinds[g], np.zeros(len(kinds), bool)
            for x in mine[mine >= 0]:
                clash |= (kinds == x).any(1)
            x, y = np.flatnonzero(left & (kind == g)), np.flatnonzero(right & ~clash[kind])
            for at in range(0, len(x), 512):
                some = x[at : at + 512]
                like = vec[some] @ vec[y].T >= threshold
                like &= ids[some][:, None] != ids[y][None, :]
                degree[some] += like @ copies[y]
                if lo != hi:
                    degree[y] += copies[some] @ like
                for i in np.flatnonzero(like.any(1)):
                    for old in np.unique(label[y[like[i]]]):
                        if old != label[some[i]]:
                            label[label == old] = label[some[i]]
        found = np.flatnonzero(degree)
        if not len(found):
            return None
        names, group = np.unique(label[found], return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[found])
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(least[group]), pa.array(degree[found])], names=["a", "b", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            cell = np.stack([batch.column(i).to_numpy() for i in range(5)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])) if len(cell) else []
            for s, e in zip(starts, [*starts[1:], len(cell)], strict=True):
                part = batch.slice(s, e - s)
                row = (*cell[s].tolist(), part.column(5).to_numpy(), part.column(6).to_numpy(), _matrix(part.column(7), len(part.column(7)[0])), _matrix(part.column(8), len(part.column(8)[0])), part.column(9).to_numpy())
                if held and held[0][:5] != row[:5]:
                    if (out := compare(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := compare(held)) is not None:
            yield out

    dealt = cells.repartition("dim", "p", "q", "lo", "hi").sortWithinPartitions("dim", "p", "q", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long, others long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, per_pivot: int = PER_PIVOT, pivots: int = PIVOTS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    good = rows.filter(F.col("id").isNotNull() & valid(F.col("vector")))
    h1, h2 = F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")
    members = good.select("id", h1.alias("h1"), h2.alias("h2"))
    classes = good.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = checkpointed(classes)
    named = classes.select(F.col("rep").alias("id"), "copies", "vector")
    index = checkpointed(pivot_index(named, choose_pivots(named, per_pivot, pivots, threshold)))
    found = checkpointed(links(index, threshold))
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    part = components(found).withColumnRenamed("node", "rep")
    per_class = classes.select("rep", "h1", "h2", "copies").join(degree, "rep", "left").join(part, "rep", "left")
    per_class = per_class.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = members.join(per_class, (F.col("h1") == F.col("c1") + 0) & (F.col("h2") == F.col("c2") + 0)).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = rows.filter(F.col("id").isNull() | ~valid(F.col("vector")))
    out = linked.union(alone.select("id", F.lit(0).cast("long"), "id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
       WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= {THRESHOLD} * a.n * b.n),
 r(id, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
 comp AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = e.vec_id LEFT JOIN comp ON comp.id = e.vec_id
"""
