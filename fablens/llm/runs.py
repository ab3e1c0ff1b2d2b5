"""Periodic runs of words, by Crochemore's partition refinement.

Positions whose next l words are equal form a class of level l. From level l to l + 1 a position keeps company with those of
its class whose successors are in one class too, so a class is split by the classes that split at the level before, all but
the largest part of each (the smaller-half strategy): every position is moved O(log n) times. Classes keep their positions in
order, as linked neighbours. Neighbours i and i + l of one class of level l are a square of period l (no shorter one: its
root would occur in between), and squares that start at neighbouring words are one run.

Only runs of at least ``FOLD`` periods are asked for. In such a run of period q, every word occurs FOLD times, and every
factor of l <= q words that a square begins with FOLD - 1 times, all within the run. So smaller classes are dead: their
positions leave, and with them, level by level, those before them. In prose few positions outlive the second level. Levels
end at a quarter of a text's words.

All texts of about ``BATCH_BYTES`` are refined together, as arrays, their words numbered apart; the memory of a task is that
of one such batch or of one longer text.

Defined cases: a null or empty text has no words and no runs; every row gives one row, so repeated rows and null ids stay;
among runs of equal exponent the first by start, then by period counts; an empty table gives an empty one; columns other than
the named ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: A run has at least so many words and so many of its periods.
LEAST, FOLD = 6, 4
BATCH_BYTES = 6 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, 0 behind each text, and where texts begin. Words of different texts have different numbers."""
    at, first, parts = np.zeros(len(texts) + 1, np.int64), 1, []
    for i, words in enumerate(texts):
        own = dict.fromkeys(words)
        own = dict(zip(own, range(first, first + len(own)), strict=True))
        first += len(own)
        parts += [np.fromiter(map(own.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        at[i + 1] = at[i] + len(words) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), at


class _Partition:
    """Classes of positions at one level; 0 is the dead class.

    order holds the positions of a class side by side, from first[class] on, size[class] of them; place is its inverse. after
    and before link the positions of a class in ascending order; since is the level from which after holds.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray):
        lengths = np.diff(at)
        self.limit = np.repeat((lengths - 1) // FOLD, lengths)
        count = np.bincount(words, minlength=1)
        count[0] = 0
        live = (count[words] >= FOLD) & (self.limit > 0)
        self.of = np.where(live, words, 0)
        held = np.flatnonzero(live)
        held = held[np.argsort(self.of[held], kind="stable")]
        self.order, self.place = held, np.zeros(len(words), np.int64)
        self.place[held] = np.arange(len(held))
        same = np.zeros(len(held), bool)
        same[1:] = self.of[held[1:]] == self.of[held[:-1]]
        heads = np.flatnonzero(~same)
        self.first, self.size = np.zeros(len(count) + len(held), np.int64), np.zeros(len(count) + len(held), np.int64)
        self.first[self.of[held[heads]]] = heads
        self.size[self.of[held[heads]]] = np.diff(np.append(heads, len(held)))
        self.classes = len(count)
        self.after, self.before = np.full(len(words), -1), np.full(len(words), -1)
        self.after[held[:-1][same[1:]]] = held[1:][same[1:]]
        self.before[held[1:][same[1:]]] = held[:-1][same[1:]]
        self.since = np.ones(len(words), np.int64)
        self.level = 1
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        self.dead = np.flatnonzero(~live)
        # of a text's classes all but the largest split those of the next level
        heads = held[heads]
        text = np.searchsorted(at, heads, "right")
        largest = np.lexsort((-self.size[self.of[heads]], text))
        lead = np.ones(len(largest), bool)
        lead[1:] = text[largest[1:]] != text[largest[:-1]]
        spared = np.zeros(self.classes, bool)
        spared[self.of[heads[largest[lead]]]] = True
        self.small = held[~spared[self.of[held]]]

    def relink(self, x: np.ndarray, after: np.ndarray) -> None:
        """Give positions x new neighbours; what the old ones were up to this level is noted if it was a square."""
        old = self.after[x]
        new = old != after
        x, old, after = x[new], old[new], after[new]
        period = old - x
        square = (old >= 0) & (self.since[x] <= period) & (period <= self.level)
        if square.any():
            self.squares.append((x[square], period[square]))
        self.after[x], self.since[x] = after, self.level + 1

    def step(self) -> bool:
        """To the next level; False if nothing can change any more."""
        # a position moves by the class of its successor
        x, by = np.concatenate([self.dead, self.small]) - 1, np.concatenate([np.zeros(len(self.dead), np.int64), self.of[self.small]])
        moves = (self.of[x] > 0) & (self.limit[x] > self.level)
        x, by = x[moves], by[moves]
        self.dead = self.small = x[:0]
        if not len(x):
            return False
        of = self.of[x]
        turn = np.lexsort((x, by, of))
        x, by, of = x[turn], by[turn], of[turn]
        # classes that lose positions; the moved go to the end of their class's places
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        split, lost = of[edge], np.diff(np.append(edge, len(of)))
        rest = self.size[split] - lost
        border = self.first[split] + rest
        slots = np.arange(len(x)) + np.repeat(border - edge, lost)
        moved_from = self.place[x]
        inside = self.order[slots]
        self.place[x] = -1
        stays = inside[self.place[inside] >= 0]
        if len(stays):
            # one for one in each class: holes before the border for those behind it that stay
            holes = moved_from[moved_from < np.repeat(border, lost)]
            self.order[holes], self.place[stays] = stays, holes
        self.order[slots], self.place[x] = x, slots
        # groups: what moved by the same class; and the rest of a class where a group is larger
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (by[1:] != by[:-1])]))
        count = np.diff(np.append(cut, len(x)))
        most = np.maximum.reduceat(np.where(by[cut] > 0, count, 0), np.searchsorted(cut, edge))
        told = rest < np.maximum(most, FOLD - 1)
        owner = np.repeat(np.arange(len(split)), lost)
        # positions that stay where they are: their neighbours close up
        quiet = ~told[owner]
        if quiet.any():
            gone = x[quiet]
            o = owner[quiet]
            turn = np.lexsort((gone, o))
            gone, o = gone[turn], o[turn]
            chained = (o[1:] == o[:-1]) & (self.after[gone[:-1]] == gone[1:])
            left, right = self.before[gone[np.concatenate([[True], ~chained])]], self.after[gone[np.concatenate([~chained, [True]])]]
            self.relink(left[left >= 0], right[left >= 0])
            self.before[right[right >= 0]] = left[right >= 0]
        self.size[split] = rest
        again = told & (rest > 0)
        if again.any():
            n = rest[again]
            where = np.arange(n.sum()) + np.repeat(self.first[split[again]] - (np.cumsum(n) - n), n)
            more = self.order[where]
            group_of = np.repeat(split[again], n)
            turn = np.lexsort((more, group_of))
            x, slots = np.concatenate([x, more[turn]]), np.concatenate([slots, where])
            cut, count = np.concatenate([cut, len(of) + np.cumsum(n) - n]), np.concatenate([count, n])
            of, by = np.concatenate([of, group_of]), np.concatenate([by, np.full(len(group_of), -1)])
            self.order[where], self.place[x[len(owner) :]] = x[len(owner) :], where
        # the largest group of a class that is told in full keeps its name
        lives = (by[cut] != 0) & (count >= FOLD - 1)
        name = np.zeros(len(cut), np.int64)
        full = np.zeros(self.classes, bool)
        full[split[told]] = True
        ranked = np.flatnonzero(lives & full[of[cut]])
        ranked = ranked[np.lexsort((-count[ranked], of[cut[ranked]]))]
        keeps = ranked[np.concatenate([[True], of[cut[ranked[1:]]] != of[cut[ranked[:-1]]]])] if len(ranked) else ranked
        fresh = lives.copy()
        fresh[keeps] = False
        name[keeps] = of[cut[keeps]]
        n_new = int(fresh.sum())
        name[fresh] = np.arange(self.classes, self.classes + n_new)
        self.classes += n_new
        if self.classes > len(self.size):
            self.first, self.size = np.concatenate([self.first, np.zeros(self.classes, np.int64)]), np.concatenate([self.size, np.zeros(self.classes, np.int64)])
        self.first[name], self.size[name] = slots[cut], count
        group = np.repeat(np.arange(len(cut)), count)
        self.of[x] = name[group]
        chained = (group[1:] == group[:-1]) & lives[group[1:]]
        after, before = np.full(len(x), -1), np.full(len(x), -1)
        after[:-1][chained], before[1:][chained] = x[1:][chained], x[:-1][chained]
        self.relink(x, after)
        self.before[x] = before
        self.dead, self.small = x[~lives[group]], x[fresh[group]]
        self.level += 1
        return True

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods of all squares of live classes."""
        while self.step():
            pass
        x = np.flatnonzero(self.of > 0)
        period = self.after[x] - x
        square = (self.after[x] >= 0) & (self.since[x] <= period) & (period <= self.limit[x])
        self.squares.append((x[square], period[square]))
        return tuple(np.concatenate(c) for c in zip(*self.squares, strict=True))


def find_runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs in ``numbered`` words, ordered by start, then period."""
    if not len(words):
        return (words,) * 3
    start, period = _Partition(words, at).finish()
    turn = np.lexsort((start, period))
    start, period = start[turn], period[turn]
    first = np.ones(len(start), bool)
    first[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    last = np.append(first[1:], True)[: len(start)]
    begin, period, length = start[first], period[first], start[last] - start[first] + 2 * period[first]
    held = np.flatnonzero(length >= np.maximum(LEAST, FOLD * period))
    held = held[np.lexsort((period[held], begin[held]))]
    return begin[held], length[held], period[held]


def _described(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    words, at = numbered(texts)
    start, length, period = find_runs(words, at)
    of = np.searchsorted(at, start, "right") - 1
    # a word after the first period of a run goes
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change) == 0
    some = np.zeros(len(texts), bool)
    some[of] = True
    kept = [b" ".join(w if not some[i] else [x for x, ok in zip(w, stays[at[i] : at[i + 1]].tolist(), strict=False) if ok]) for i, w in enumerate(texts)]
    runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start - at[of], length, period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), runs)
    columns = [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words that no run repeats, joined by one space.

    ``rewrite`` may change a row's words (UTF-8) before they are looked at.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                words = data.split()  # of bytes, that is at [\x20\x09-\x0D]+
                ids.append(i)
                texts.append(rewrite(i, words) if rewrite else words)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _described(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield _described(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """A row for each of ``word_runs``: counts, the run of greatest exponent, and digests of runs and collapsed text."""
    lead = F.reduce("runs", F.element_at("runs", 1), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
    best = F.when(F.size("runs") > 0, lead)
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``op11``'s rows: in one of ten texts the words from some place on repeat with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11(spark, sf_dir: str) -> DataFrame:
    return run_digests(word_runs(table(spark, sf_dir, "documents"), rewrite=planted))


#: crc32 of an ASCII string, a bit at a time.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(t) + 1), lambda k: ascii(substr(t, k, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
#: Every stretch of every period, those that hold a shorter period left out: for small tables.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {_CRC} AS h FROM d),
a AS (SELECT *, h % 10 = 0 AND n > 0 AS odd, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
p AS (SELECT doc_id, n, CASE WHEN odd THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM a),
o AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM p WHERE n >= 6),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g f WHERE f.doc_id = g.doc_id AND f.q < g.q AND f.s <= g.s AND f.s + f.m >= g.s + g.m)),
z AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS runs, list(s + q ORDER BY s, q) AS lo, list(s + m ORDER BY s, q) AS hi FROM r GROUP BY 1),
b AS (SELECT doc_id, s, m, q FROM r k WHERE NOT EXISTS (SELECT 1 FROM r f WHERE f.doc_id = k.doc_id AND (f.m * k.q > k.m * f.q OR f.m * k.q = k.m * f.q AND (f.s, f.q) < (k.s, k.q))))
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, 1000 * b.m // b.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
 sha256(array_to_string(CASE WHEN n_runs IS NULL THEN w ELSE list_filter(w, lambda x, i: len(list_filter(range(1, n_runs + 1), lambda k: lo[k] <= i - 1 AND i - 1 < hi[k])) = 0) END, ' ')) AS collapsed_sha256
FROM p LEFT JOIN z ON z.doc_id = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id
"""
