"""Exact removal of repeated byte strings, with suffix arrays over the places that can repeat.

Every byte that lies in a string of ``LENGTH`` (100) bytes which also starts earlier (in a document of smaller id, or
earlier in the same one) is removed. A global suffix array of the corpus is not needed for that:

anchors    Each 100-byte window has an anchor: the leftmost smallest hash among its 32-byte strings. Equal windows have
           equal anchors in the same place, and the windows of one anchor are a run of starts, its segment. So windows that
           may be equal meet by the anchor's hash.
groups     Segments with the same anchor and the same content (by 64 bits of hash each) are one variant: all but its first
           occurrence are removed whole. A task keeps the first of those that it meets itself, so a passage that most texts
           hold reaches the others as a row for each task. Anchors with one variant are done. Else the first occurrences of
           the variants are compared.
suffixes   Their bytes are joined to one text and its suffix array is made by two-stage sorting (``suffixes``), then the
           lengths of the prefixes that neighbours have in common. Windows whose neighbours share 100 bytes are equal, and all
           but the first are removed.
hot groups An anchor with more than ``VARIANTS`` variants (a passage in many contexts, or in one long log) is dealt over blocks
           by document and place; a block's first windows meet again by 128 bits of hash, in an aggregate with a map-side part.

No copy of the texts is kept: they are shuffled by document twice, once to cut out the segments asked for and once for the
result, and what one of the steps shuffled is released before the next. Where no id repeats, an id tells its text and the
text's hash isn't carried.

Defined cases: a null text is empty; rows with equal id and text are one document with a row each in the result; rows
with equal id and different texts are ordered by a hash of 64 bits of their text, which also tells them apart; null ids come
before all others, told apart and ordered by 128 bits of hash; texts shorter than 100 bytes lose nothing; other columns are
not read, and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, ship, table
from .shingles import mix
from .suffixes import common_prefixes, eight, suffix_array

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of text that are hashed at once, and of segments that one suffix array covers.
PIECE, TEXT = 1 << 19, 1 << 21
#: First occurrences of an anchor that are compared in one suffix array: at most 168 bytes each.
VARIANTS = 2048
FLUSH = 1 << 20
#: Seconds that a release of shuffle files waits.
WAIT = 1.5
#: What a document is known by: 1 if its id isn't null, the id or a hash, a hash of the text.
_DOC = ["z", "k", "h"]
_PLACE = np.uint64((1 << 22) - 1)
_BYTE = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ANCHOR = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("z", "u1"), ("k", "<i8"), ("h", "<i8"), ("lo", "<u4"), ("off", "u1"), ("cnt", "u1"), ("late", "u1")])


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + (1 << 12)), _powers(_INVERSE, PIECE + (1 << 12))


def anchors(data: np.ndarray, owner: np.ndarray, base: np.ndarray, ends: np.ndarray, z: np.ndarray, k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The anchors of joined texts. owner: for each byte, the number of its text; ends: where texts end; base: the place in
    its document of each text's first byte, less its place here."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, _ANCHOR)
    value = _BYTE[data]
    g, width = value, 1
    while width < GRAM:
        g = g[:-width] * _UP[width] + g[width:]
        width *= 2
    g = mix(g)
    best = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[SPAN - width : SPAN - width + n])
    place = (best & _PLACE).astype(np.int64)
    inside = np.flatnonzero(np.arange(n) + LENGTH <= ends[owner[:n]])  # starts of windows within one text
    if not len(inside):
        return np.zeros(0, _ANCHOR)
    p = place[inside]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)
    starts = np.flatnonzero(new)
    lo = inside[starts]
    cnt = np.diff(np.append(starts, len(p)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _UP[: len(value)], dtype=np.uint64)])
    stop = lo + cnt + LENGTH - 1
    out = np.zeros(len(lo), _ANCHOR)
    doc = owner[lo]
    out["anchor"] = g[p[starts]]
    out["off"], out["cnt"] = p[starts] - lo, cnt
    out["content"] = mix((total[stop] - total[lo]) * _DOWN[lo] + out["off"].astype(np.uint64) * np.uint64(256) + out["cnt"])
    out["z"], out["k"], out["h"], out["lo"] = z[doc], k[doc], h[doc], lo + base[doc]
    return out


def pieces(z: int, k: int, h: int, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A text in overlapping pieces, so that each window is in one of them: (z, k, h, place of the piece, bytes)."""
    for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE - LENGTH + 1):
        yield z, k, h, at, raw[at : at + PIECE]


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b are of the very same place."""
    return (t["z"][a] == t["z"][b]) & (t["k"][a] == t["k"][b]) & (t["h"][a] == t["h"][b]) & (t["lo"][a] == t["lo"][b])


def _ordered(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table by anchor, content and place, without repeated places; and whether each row is the first of its variant."""
    t = t[np.lexsort((t["lo"], t["h"], t["k"], t["z"], t["content"], t["anchor"]))]
    at = np.arange(1, len(t))
    alike = (t["anchor"][1:] == t["anchor"][:-1]) & (t["content"][1:] == t["content"][:-1])
    keep = np.append(np.ones(min(1, len(t)), bool), ~(alike & _same(t, at, at - 1)))
    t = t[keep]
    first = np.ones(len(t), bool)
    first[1:] = (t["anchor"][1:] != t["anchor"][:-1]) | (t["content"][1:] != t["content"][:-1])
    return t, first


def _deal(table: np.ndarray, parts: int) -> pa.RecordBatch:
    table, first = _ordered(table)
    # what a task meets again is late wherever the first stands; it needs no place among the others
    table["late"] = ~first
    part = (np.where(first, table["anchor"], mix(table["k"].astype(np.uint64) + table["lo"])) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((table["lo"], table["h"], table["k"], part))  # by document, which compresses better
    table, part = table[order], part[order]
    ends = np.searchsorted(part, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(ends))
    # by columns, which compress better
    blobs = [b"".join(np.ascontiguousarray(table[f][ends[p] : ends[p + 1]]).tobytes() for f in _ANCHOR.names) for p in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])


def _undeal(blocks: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(len(b) for b in blocks) // _ANCHOR.itemsize, _ANCHOR)
    at = 0
    for b in blocks:
        n, place = len(b) // _ANCHOR.itemsize, 0
        for f in _ANCHOR.names:
            out[f][at : at + n] = np.frombuffer(b, _ANCHOR[f], n, place)
            place += n * _ANCHOR[f].itemsize
        at += n
    return out


def _anchor_blocks(rows: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, held, n = [], 0, [], 0

        def hashed() -> np.ndarray:
            lengths = np.array([len(x[4]) for x in waiting])
            ends = np.cumsum(lengths)
            data = np.frombuffer(b"".join(x[4] for x in waiting), np.uint8)
            base = np.array([x[3] for x in waiting]) - (ends - lengths)
            return anchors(data, np.repeat(np.arange(len(waiting)), lengths), base, ends, *(np.array([x[i] for x in waiting], np.int64) for i in range(3)))

        for batch in batches:
            for z, k, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < LENGTH:
                    continue
                for piece in pieces(z, k, h, raw):
                    if size + len(piece[4]) > PIECE and waiting:
                        held.append(hashed())
                        n += len(held[-1])
                        waiting, size = [], 0
                    waiting.append(piece)
                    size += len(piece[4])
                if n >= FLUSH:
                    yield _deal(np.concatenate(held), parts)
                    held, n = [], 0
        if waiting:
            held.append(hashed())
        if held:
            yield _deal(np.concatenate(held), parts)

    return rows.mapInArrow(run, "part int, block binary")


_FOUND = pa.schema([("z", pa.int32()), ("k", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("cnt", pa.int32()), ("anchor", pa.int64()), ("share", pa.int32())])
_FOUND_DDL = "z int, k long, h long, lo long, cnt int, anchor long, share int"


def _groups(blocks: DataFrame) -> DataFrame:
    """share -1: a run of windows to remove. Other rows: a variant's first occurrence, to be compared with those of the same
    anchor and share; share is 0, or 1 and more for an anchor of many variants."""

    def judged(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = _undeal(held)
        cut = t["late"] == 1
        late, (t, first) = t[cut], _ordered(t[~cut])
        group = np.ones(len(t), bool)
        group[1:] = t["anchor"][1:] != t["anchor"][:-1]
        number = np.cumsum(group) - 1
        variants = np.bincount(number, weights=first).astype(int)[number] if len(t) else np.zeros(0, int)
        shares = np.maximum(-(-variants // VARIANTS), 1)
        spread = mix(mix(t["k"].astype(np.uint64) ^ t["h"].astype(np.uint64)) + t["lo"])
        share = np.where(shares > 1, 1 + (spread % shares.astype(np.uint64)).astype(np.int64), 0)
        share = np.where(first, share, -1)
        keep = ~first | (variants > 1)
        t, share = np.concatenate([t[keep], late]), np.concatenate([share[keep], np.full(len(late), -1)])
        for i in range(0, len(t), 100_000):
            x = t[i : i + 100_000]
            columns = [x["z"].astype(np.int32), x["k"], x["h"], x["lo"].astype(np.int64), x["cnt"].astype(np.int32), np.ascontiguousarray(x["anchor"]).view(np.int64), share[i : i + 100_000].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield from judged(held)
                    held = []
                part = p
                held.append(block)
        if held:
            yield from judged(held)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, _FOUND_DDL)


def _segments(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the segments asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_FOUND, ("bytes", pa.binary())])
        for batch in batches:
            for z, k, h, text, wants in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                rows = [{**w, "z": z, "k": k, "h": h, "bytes": raw[w["lo"] : w["lo"] + w["cnt"] + LENGTH - 1]} for w in wants]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wanted = asked.groupBy(*_DOC).agg(F.collect_list(F.struct("lo", "cnt", "anchor", "share")).alias("wants"))
    return texts.join(wanted, _DOC).select(*_DOC, "text", "wants").mapInArrow(run, _FOUND_DDL + ", bytes binary")


def _compared(segments: DataFrame) -> DataFrame:
    """z, k, h, lo, cnt: runs of windows to remove; with w1 and w2, a hash of the window, for windows of a hot anchor that are
    the first in their share (cnt 1)."""
    names = ["z", "k", "h", "lo", "cnt", "w1", "w2"]

    def compared(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held = list({x[:4]: x for x in held}.values())  # rows of the same id and text are one document
        z, k, h, lo, cnt, share = (np.array([x[i] for x in held], np.int64) for i in range(6))
        lengths = np.array([len(x[6]) for x in held])
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
        seg = np.repeat(np.arange(len(held)), cnt)
        t = np.arange(len(seg)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        window = np.full(len(text), -1)
        window[starts[seg] + t] = np.arange(len(seg))
        order = window[suffix_array(text, LENGTH)]
        order = order[order >= 0]
        words = eight(text)
        at = starts[seg] + t
        # of windows that are equal but in different shares of a hot anchor, each share keeps one
        shared = common_prefixes(words, at[order[:-1]], at[order[1:]], LENGTH)
        new = np.append(np.ones(min(1, len(order)), bool), shared < LENGTH)
        rank = np.empty(len(seg), np.int64)
        rank[np.lexsort((lo[seg] + t, h[seg], k[seg], z[seg]))] = np.arange(len(seg))
        least = np.minimum.reduceat(rank[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        cut = np.zeros(len(seg), bool)
        cut[order] = rank[order] != least

        def rows(w: np.ndarray, n: np.ndarray, *hashes: pa.Array) -> pa.RecordBatch:
            of = seg[w]
            return pa.RecordBatch.from_arrays([pa.array(z[of].astype(np.int32)), pa.array(k[of]), pa.array(h[of]), pa.array(lo[of] + t[w]), pa.array(n.astype(np.int32)), *hashes], names=names)

        gone = np.flatnonzero(cut)
        if len(gone):
            run = np.ones(len(gone), bool)
            run[1:] = (gone[1:] != gone[:-1] + 1) | (seg[gone[1:]] != seg[gone[:-1]])
            n = np.diff(np.append(np.flatnonzero(run), len(gone)))
            none = pa.nulls(len(n), pa.int64())
            yield rows(gone[run], n, none, none)
        stay = np.flatnonzero(~cut & (share[seg] > 0))
        if len(stay):
            place = at[stay]
            w1 = w2 = np.zeros(len(stay), np.uint64)
            for d in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
                w1, w2 = mix(w1 * np.uint64(0xC2B2AE3D27D4EB4F) + words[place + d]), mix((w2 ^ words[place + d]) * np.uint64(0x165667B19E3779F9) + np.uint64(d + 1))
            yield rows(stay, np.ones(len(stay)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("z", "k", "h", "lo", "cnt", "share", "bytes", "anchor")), strict=True):
                # shares of a hot anchor are cut apart anywhere: their windows meet again
                if size >= TEXT and (row[7] != last or row[5] > 0):
                    yield from compared(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[7]
        if held:
            yield from compared(held)

    return segments.repartition("anchor", "share").sortWithinPartitions("anchor", "share").mapInArrow(run, "z int, k long, h long, lo long, cnt int, w1 long, w2 long")


def _removed(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                runs = sorted((x["lo"], x["lo"] + x["cnt"] + LENGTH - 1) for x in own.as_py() or ())
                spans: list[list[int]] = []
                for a, b in runs:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in [*spans, [len(raw), 0]]:
                    kept.update(raw[at:a])
                    at = b
                out["doc_id"].append(doc)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(kept.hexdigest())
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    own = cuts.groupBy(*_DOC).agg(F.collect_list(F.struct("lo", "cnt")).alias("own"))
    joined = texts.join(own, _DOC, "left").select("doc_id", "text", "own")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges to remove)."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    h1, h2 = (F.xxhash64(*[F.lit(i)] * i, F.coalesce("text", F.lit(""))) for i in range(2))
    z = F.col("doc_id").isNotNull()
    if rows.filter(z).groupBy("doc_id").count().filter("count > 1").isEmpty():
        h1 = F.when(z, F.lit(0).cast("long")).otherwise(h1)
    rows = rows.select(z.cast("int").alias("z"), F.coalesce("doc_id", h2).alias("k"), h1.alias("h"), "text", "doc_id")
    found = checkpointed(_groups(_anchor_blocks(rows.select(*_DOC, "text"), 4 * n)))
    release(spark, WAIT)
    compared = checkpointed(_compared(_segments(found.filter("share >= 0"), rows)))
    release(spark, WAIT)
    cuts = found.filter("share < 0").select(*_DOC, "lo", "cnt").union(compared.filter("w1 IS NULL").select(*_DOC, "lo", "cnt"))
    # a window is met once in each share of its anchor
    order = Window.partitionBy("w1", "w2").orderBy(*_DOC, "lo")
    late = compared.filter("w1 IS NOT NULL").withColumn("place", F.rank().over(order)).filter("place > 1")
    result = checkpointed(_removed(rows, cuts.union(late.select(*_DOC, "lo", "cnt"))))
    del found, compared, cuts, late
    release(spark, WAIT)
    return result


def op2(spark, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")


#: All windows of 100 bytes, by digest: for small tables.
OP2_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 100)) AS k FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(hex(array_slice(b, e + 1, a)), '' ORDER BY a) AS head, max(z) AS last FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
