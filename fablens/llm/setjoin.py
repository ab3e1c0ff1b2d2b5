"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are dealt into bands of sizes so that similar sets lie in the same or the next band; each set signs for its own band
and for the next. Within a band, sets of the asked Jaccard similarity or more differ in at most k elements. The feature domain is
hashed into n1 parts of n2 subparts each, with n1 * (k2 + 1) > k; at least one part then holds at most k2 differences, and
of its subparts some n2 - k2 hold none. So a signature for each part and each choice of n2 - k2 subparts (part number,
choice and the elements in it) makes every similar pair share one. With k2 = 1 and n2 = 2 there are about k + 1 of them.
A subpart of fewer than ``LEAST`` elements tells sets badly apart: many share it. But the part's other subpart then has at
most one difference too, so it is cut into ``PIECES``, and there is a signature with all of them but one for each of them.

That k is of the band's largest sets. Sets x and y of a band differ in at most d = (|x| + |y|) * (100 - p) / (100 + p) elements,
so n1 - d / 2 parts or more hold at most one difference. Each set leaves out (n1 - 1) / 2 parts less its own share of d / 2, so
both together leave out fewer parts than that, and one that both sign is left. It leaves out those whose signatures hold the
fewest elements: unrelated sets share them, in buckets that grow with the table.

A band whose similar sets are equal sets (k = 0) needs no signature.

Signatures meet by hash, as packed binary blocks. A bucket of at most ``SMALL`` sets gives all its pairs. In a larger one
every set is compared with the bucket's first, its leader. Links found so far label the sets, and only pairs of sets of
different labels, of which one at least isn't similar to the leader, are still open. A group of up to ``WHOLE`` sets meets
by sketches, in blocks. In larger ones pairs are found exactly by their differences from the leader: if D(x) is what x and the leader r do not share, then x and y differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, so a similar pair must share so many elements of D that one of them lies in a
short prefix of both (elements that r lacks come first, being rare). Of those that meet so, parity sketches (whose differing
bits are never more than the elements that differ) rule out most, and each far set is compared with its nearest of the rest;
links join labels, and who has other hopeful partners of another label meets more of them in the next round, until none has.
No bucket's pairs are all listed and none is capped.

Exact copies are one class each, found by a digest of their set, and sign once for each task. Similarity is decided on
64-bit shingle hashes: (100 + p) |x ^ y| <= (100 - p) (|x| + |y|) is the same as 100 |x & y| >= p |x | y|.

Defined cases: a text that is null or has no word has an empty set and links with nothing; rows that share an id are one
node; a null id links with nothing and has a null component; every input row gives one output row; ties do not arise, as a
component's id is its smallest id; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, fresh_name, release, ship, table
from .components import components, joinable
from .shingles import mix, shingle_set

#: op9's shingles and similarity: three words, a Jaccard similarity of at least 0.9.
K = 3
PERCENT = 90
N2, K2 = 2, 1
LEAST, PIECES = 1, 4
#: A bucket of so many sets or fewer gives all its pairs.
SMALL = 8
#: Sets of one meeting in a task; second leaders that a group gets.
BLOCK, RELEADS = 8192, 2
#: Sets up to which a group meets whole, in blocks; in larger ones only sets that share a prefix element meet.
WHOLE = 4 * BLOCK
#: Ids (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 1 << 17
#: Signatures that a task holds before it sends them on.
FLUSH = 1 << 20
#: Bytes of a signature that are sent, and the kinds of steps between ids.
_KEPT, _STEPS = 5, (np.int8, np.int16, np.int32, np.int64)


_LAST: dict[int, list[int]] = {}  # by percent, largest size of each band: the largest that a set of its smallest size may match


def bands(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The band of size n and the next: (number, largest size)."""
    last = _LAST.setdefault(percent, [100 // percent])
    while len(last) < 2 or last[-2] < n:
        last.append((last[-1] + 1) * 100 // percent)
    i = bisect_left(last, n)
    return [(i, last[i]), (i + 1, last[i + 1])]


def bounds(percent: int) -> tuple[int, int]:
    """(up, down): similar is up * differences <= down * sum of sizes."""
    if not 0 < percent < 100:
        raise ValueError("percent must be between 1 and 99")
    common = gcd(100 + percent, 100 - percent)
    return (100 + percent) // common, (100 - percent) // common


@functools.lru_cache(maxsize=1 << 12)
def _frame(number: int, n1: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a band: where its pieces end, and the hashes of (band, part) for each choice."""
    h = [np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(c) for c in range(N2)]
    return np.arange(n1 * N2 * PIECES + 1, dtype=np.uint64), [mix(x + np.uint64(number * 0x165667B19E3779F9 & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F) for x in h]


def spare_parts(n: int, n1: int, percent: int = PERCENT) -> int:
    """Parts that a set of size n leaves out in a band of ``n1`` parts: those of it and of any similar set are fewer than the
    parts that hold at most one of their differences."""
    up, down = bounds(percent)
    return max(0, ((n1 - 1) * up - n * down) // (2 * up))


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The PartEnum signatures of a set of hashes."""
    up, down = bounds(percent)
    out, value = [], None
    for number, largest in bands(len(elements), percent):
        k = 2 * largest * down // up
        if k == 0:  # only equal sets are similar, and those are one class already
            continue
        if value is None:  # the content of a subpart or piece: its elements' sum under a second hash, with their number
            value = mix(elements * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        n1 = -(-(k + 1) // (K2 + 1))
        bins, parts = _frame(number, n1)
        place = mix(elements + np.uint64(number))
        piece = (place >> np.uint64(11)) % np.uint64(n1 * N2) * np.uint64(PIECES) + place % np.uint64(PIECES)
        order = np.argsort(piece)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value[order], dtype=np.uint64, out=total[1:])
        ends = np.searchsorted(piece[order], bins)
        n = np.diff(ends)
        sums = total[ends]
        pieces = (sums[1:] - sums[:-1] + n.astype(np.uint64)).reshape(n1, N2, PIECES)
        whole = pieces.sum(2, dtype=np.uint64)
        counts = n.reshape(n1, N2, PIECES)
        size = counts.sum(2)
        few = size < LEAST
        # the parts whose signatures hold the fewest elements are left out: those are shared by sets that have little in common
        least = np.where(few, size + (size - counts.max(2))[:, ::-1], size).min(1)
        signs = np.sort(np.argsort(least, kind="stable")[spare_parts(len(elements), n1, percent) :])
        whole, pieces, few = whole[signs], pieces[signs], few[signs]
        content = mix(whole)
        for c in range(N2):
            h = mix(parts[c][signs] + content[:, c])
            short = few[:, c]
            if not short.any():
                out.append(h)
                continue
            out.append(h[~short])
            rest = mix(whole[short, 1 - c, None] - pieces[short, 1 - c])
            out.append(mix((h[short, None] + np.arange(1, PIECES + 1, dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + rest).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pack(s: np.ndarray, d: np.ndarray) -> bytes:
    """Signatures with their ids: the upper 40 bits of each (two that agree by chance only make one more pair to verify), and
    the ids' steps in as few bytes as all of them fit in."""
    steps = np.diff(d)
    kind = next(k for k in _STEPS if not len(steps) or (steps.min() >= np.iinfo(k).min and steps.max() <= np.iinfo(k).max))
    upper = (s >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT]
    return b"".join((len(s).to_bytes(4, "little"), d[:1].tobytes(), steps.astype(kind).tobytes(), upper.tobytes()))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    upper = np.zeros((n, 8), np.uint8)
    at = len(block) - _KEPT * n
    upper[:, :_KEPT] = np.frombuffer(block, np.uint8, _KEPT * n, at).reshape(n, _KEPT)
    steps = np.frombuffer(block, f"i{(at - 12) // (n - 1)}", n - 1, 12) if n > 1 else np.zeros(0, np.int64)
    return upper.view("<u8").ravel(), np.cumsum(np.concatenate([np.frombuffer(block, np.int64, 1, 4), steps]), dtype=np.int64)


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def signed_sets(docs: DataFrame, k: int = K, percent: int = PERCENT, parts: int = 1) -> DataFrame:
    """Of one pass over the texts: a row for each document (doc_id, n_shingles, digest and bits, its sketch, both null for an
    empty set), and rows of signatures (block), in the part that is a signature's remainder by ``parts``. Documents go to the parts in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sigs, ids, held, turn = [], [], 0, TaskContext.get().partitionId() * 7919
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), ("part", pa.int32()), ("block", pa.binary())])

        def packed() -> pa.RecordBatch:
            s, d = np.concatenate(sigs), np.concatenate(ids)
            part = (s % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            s, d, part = s[order], d[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            blobs = [pack(s[ends[p] : ends[p + 1]], d[ends[p] : ends[p + 1]]) for p in some]
            none = [pa.nulls(len(some), f.type) for f in list(schema)[:4]]
            return pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

        for batch in batches:
            sizes, digests, bits = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                bits.append(sketch(s, percent).tobytes() if len(s) else None)
                if doc is None or not len(s) or digests[-1] in seen:
                    continue
                seen.add(digests[-1])
                got = signatures(s, percent)
                if len(got):
                    sigs.append(got)
                    ids.append(np.full(len(got), doc, np.int64))
                    held += len(got)
                if held >= FLUSH:
                    yield packed()
                    sigs, ids, held = [], [], 0
            part = (turn + np.arange(batch.num_rows)) % parts
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(part, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], schema=schema)
        if sigs:
            yield packed()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bits binary, part int, block binary")


def candidates(signed: DataFrame) -> DataFrame:
    """The documents of ``signed`` as they are, and rows of a, b, large: pairs of ids that share a signature; in a large bucket,
    its leader a with each other set b. The signatures end here."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("large", pa.bool_())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            s, d = (np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True))
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d = s[fresh], d[fresh]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(s)]]))
            for large in (False, True):
                found = []
                use = counts > SMALL if large else (counts > 1) & (counts <= SMALL)
                at, n = starts[use], counts[use]
                for step in range(1, 2 if large else SMALL):  # pairs (i, i + step) of small buckets; leaders of large ones
                    if large:
                        lead = np.repeat(at, n - 1)
                        rest = np.arange((n - 1).sum()) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + lead + 1
                        found.append((d[lead], d[rest]))
                    else:
                        more = np.maximum(n - step, 0)
                        left = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + np.repeat(at, more)
                        found.append((d[left], d[left + step]))
                if not found:
                    continue
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(a):
                    both = np.unique(np.stack([a, b], 1), axis=0)
                    for i in range(0, len(both), 100_000):
                        x = both[i : i + 100_000]
                        none = [pa.nulls(len(x), f.type) for f in list(schema)[:4]]
                        yield pa.RecordBatch.from_arrays([*none, pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.full(len(x), large))], schema=schema)

        for batch in batches:
            own = batch.filter(batch.column("block").is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(4)), *(pa.nulls(own.num_rows, f.type) for f in list(schema)[4:])], schema=schema)
            sent = batch.filter(batch.column("block").is_valid())
            for p, block in zip(sent.column("part").to_pylist(), sent.column("block").to_pylist(), strict=True):
                if p != part and blocks:
                    yield from pairs()
                    blocks = []
                part = p
                blocks.append(block)
        if blocks:
            yield from pairs()

    dealt = signed.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "doc_id long, n_shingles long, digest binary, bits binary, a long, b long, large boolean")


def common_leaders(pairs: DataFrame) -> DataFrame:
    """``pairs`` with each leader of large buckets replaced by its own smallest leader, if it has one. Buckets of one group of
    near copies then mostly have one leader, and any set may serve: differences from it are what counts."""
    large = pairs.filter("large")
    own = large.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "a")
    moved = large.join(joinable(own, "a"), "a", "left").select(F.coalesce("least", "a").alias("a"), "b").filter("a <> b")
    # a leader stays with the sets that it led
    kept = moved.union(own.select(F.col("least").alias("a"), F.col("a").alias("b")))
    return kept.withColumn("large", F.lit(True)).union(pairs.filter("NOT large").select("a", "b", "large")).groupBy("a", "b").agg(F.max("large").alias("large"))


def sets_of(docs: DataFrame, ids: DataFrame, k: int = K) -> DataFrame:
    """id, s: the shingle hashes of the documents whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    wanted = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, s array<long>")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with x and y, the sets of a and b."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return one.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")


def similar(differences, sizes, percent: int = PERCENT):
    up, down = bounds(percent)
    return up * differences <= down * sizes


def sketch(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Parities of the elements, a power of two of bytes wide, so that a wider sketch folds to a narrower one.

    It has four to eight bits (or 256 in all) for each element that similar sets of this size may differ in: sets with little in
    common differ in half the bits, twice what is allowed."""
    up, down = bounds(percent)
    width = 1 << max(5, (len(elements) * down // up).bit_length())
    odd = np.bincount((mix(elements) % np.uint64(8 * width)).astype(np.int64), minlength=8 * width) & 1
    return np.packbits(odd.astype(bool))


def judged(pairs: DataFrame, drawn: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, large, nr and n (their sizes), maybe: whether sketches leave it open that the two are similar. Their differing bits
    are never more than the elements that differ, so only open pairs are met by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for nr, n, p, q in zip(*(batch.column(c).to_pylist() for c in ("nr", "n", "p", "q")), strict=True):
                width = min(len(p), len(q))
                x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, width // 8), axis=0) for z in (p, q))
                held.append(bool(similar(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)), n + nr, percent)))
            columns = ["a", "b", "large", "nr", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(held, pa.bool_())], names=[*columns, "maybe"])

    both = pairs.join(drawn.select(F.col("id").alias("b"), "n", F.col("bits").alias("q")), "b")
    both = both.join(drawn.select(F.col("id").alias("a"), F.col("n").alias("nr"), F.col("bits").alias("p")), "a")
    return both.select("a", "b", "large", "nr", "n", "p", "q").mapInArrow(run, "a long, b long, large boolean, nr long, n long, maybe boolean")


def with_label(rows: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the smallest id that links known so far reach from ``key``."""
    own = joinable(labels.select(F.col("node").alias(key), "component"), key)
    return rows.join(own, key, "left").withColumn("label", F.coalesce("component", key)).drop("component")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (r, id, far) with their labels, of the groups whose sets have several. The leader has met all of its group."""
    named = with_label(members, labels)
    several = named.groupBy("r").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("r")
    return named.join(joinable(several, "r"), "r", "left_semi")


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The similar ones of ``pairs`` (a, b; written already), by the sets of their texts in ``rows`` (doc_id, text). Texts are
    shuffled, being a fraction of their sets; of few pairs only theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, x = None, None
        for batch in batches:
            held = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                text = left.as_py()
                if x is None or text != of:  # rows come by their a
                    of, x = text, shingle_set(text, k)
                y = shingle_set(right.as_py(), k)
                n = len(x) + len(y)
                held.append(bool(similar(n - 2 * len(np.intersect1d(x, y, assume_unique=True)), n, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    both = pairs.join(rows.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    both = both.join(rows.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links: only their labels' own graph is walked again. links: written already."""
    if links.isEmpty():
        return labels
    ends = with_label(with_label(links.select("a", "b"), labels, "a").select(F.col("label").alias("u"), "b"), labels, "b")
    merged = components(ends.select("u", F.col("label").alias("v")), "u", "v")
    moved = merged.select((F.col("node") + 0).alias("component"), F.col("component").alias("first"))
    kept = labels.join(moved, "component", "left").select("node", F.coalesce("first", "component").alias("component"))
    return checkpointed(kept.union(merged.select("node", "component")))


def second_leaders(members: DataFrame) -> DataFrame:
    """a, b: in each group the smallest set that is far from the leader, with every set of another label."""
    led = members.filter("far").groupBy("r").agg(F.min(F.struct("id", "label")).alias("s"))
    led = joinable(led.select("r", F.col("s.id").alias("a"), F.col("s.label").alias("own")), "r")
    return members.join(led, "r").filter("label <> own").select("a", F.col("id").alias("b")).distinct()


def entries(led: DataFrame, percent: int) -> DataFrame:
    """r, e, id, n, far: a row for each prefix element of a set's differences from its leader r.

    led: r, id, n (size), nr (size of r), extra and missing (what the set has and r lacks, and the other way round), far
    (not similar to r). Similar sets, of which one is far from r at least, share a prefix element.
    """
    up, down = bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("r", "id", "n", "nr", "far"))
            for r, i, n, nr, far, extra, missing in zip(*values, batch.column("extra"), batch.column("missing"), strict=True):
                d = np.concatenate([np.sort(extra.values.to_numpy()), np.sort(missing.values.to_numpy())])
                # any similar partner that is far from r shares at least t elements of d; any partner at all, at least u
                t, u = max(1, -(-(up * len(d) + down * (nr - n) + 1) // (2 * up))), max(1, -(-(up * len(d) - down * (nr + n)) // (2 * up)))
                prefix = d[: max(0, len(d) - (u if far else t) + 1)]
                same = lambda x, kind, m=len(prefix): pa.array(np.full(m, x), kind)
                yield pa.RecordBatch.from_arrays([same(r, pa.int64()), pa.array(prefix, pa.int64()), same(i, pa.int64()), same(n, pa.int64()), same(far, pa.bool_())], names=["r", "e", "id", "n", "far"])

    return led.select("r", "id", "n", "nr", "far", "extra", "missing").mapInArrow(run, "r long, e long, id long, n long, far boolean")


def hopeful_partners(rows: DataFrame, drawn: DataFrame, labels: DataFrame, most: int, percent: int) -> DataFrame:
    """a, b, more_a, more_b: for each far set its ``most`` nearest by sketch among the sets of other labels that share a prefix
    element and that sketches don't rule out; more says for a and b that there are others.

    rows: r, e, id, n, far; those that share r and e meet. Only meetings of several labels go on. A meeting of more than
    ``BLOCK`` sets is dealt over blocks, each set at home in one; far sets visit all of them.
    """

    def meet(held: list[tuple]) -> pa.RecordBatch | None:
        held.sort(key=lambda x: x[1])  # by size: those that may be similar to a set by their sizes stand together
        ids, n, label = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 3))
        far, home = (np.array([x[c] for x in held], bool) for c in (2, 4))
        raw = [np.frombuffer(x[5], np.uint64) for x in held]
        width = np.array([len(x) for x in raw])
        fold = lambda x, w: np.bitwise_xor.reduce(x.reshape(-1, w), axis=0)
        wide = {w: np.flatnonzero(width >= w) for w in np.unique(width)}
        folded = {w: np.stack([fold(raw[j], w) for j in every]) for w, every in wide.items()}
        up, down = bounds(percent)
        # two sizes differ by no more than the sets do
        low, high = np.searchsorted(n, -(-n * (up - down) // (up + down))), np.searchsorted(n, n * (up + down) // (up - down), "right")
        found: list[tuple] = []
        for i in np.flatnonzero(far):
            other, least = [], []
            for w, every in wide.items():  # two sets are compared at the narrower one's width
                if w <= width[i]:
                    lo, hi = np.searchsorted(every, (low[i], high[i]))
                    near = every[lo:hi]
                    some = np.flatnonzero(home[near] & (label[near] != label[i]) & ((width[near] == w) | (w == width[i])))
                    other.append(near[some])
                    least.append(np.bitwise_count(fold(raw[i], w) ^ folded[w][lo:hi][some]).sum(1, dtype=np.int64))
            others, least = np.concatenate(other), np.concatenate(least)
            fine = similar(least, n[i] + n[others], percent)
            others, least = others[fine], least[fine]
            near = others[np.lexsort((ids[others], least))[:most]]
            more = len(others) > most
            found += [(min(ids[i], x), max(ids[i], x), more and ids[i] < x, more and ids[i] > x) for x in ids[near]]
        if not found:
            return None
        kinds = {"a": pa.int64(), "b": pa.int64(), "more_a": pa.bool_(), "more_b": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("r", "e", "block", "id", "n", "far", "label", "home", "bits"))
            for r, e, block, i, n, far, label, home, bits in zip(*columns, strict=True):
                if key != (r, e, block):
                    if len(held) > 1 and (out := meet(held)) is not None:
                        yield out
                    key, held = (r, e, block), []
                held.append((i, n, far, label, home == block, bits))
        if len(held) > 1 and (out := meet(held)) is not None:
            yield out

    named = with_label(rows, labels)
    met = named.groupBy("r", "e").agg(F.count("*").alias("sets"), F.max("far").alias("some"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("some AND lo < hi")
    met = joinable(joinable(met.select("r", "e", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), "r"), "e")
    dealt = named.join(met, ["r", "e"]).withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("far"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    dealt = dealt.join(joinable(drawn.select("id", "bits"), "id"), "id").select("r", "e", "block", "id", "n", "far", "label", "home", "bits")
    dealt = dealt.repartition("r", "e", "block").sortWithinPartitions("r", "e", "block")
    return dealt.mapInArrow(run, "a long, b long, more_a boolean, more_b boolean").groupBy("a", "b").agg(F.max("more_a").alias("more_a"), F.max("more_b").alias("more_b"))


def still_open(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` of the meetings that the next round needs: those of a far set that has more partners, by ``pairs``. Only such sets
    stay far there; every other one has met all its hopeful partners, and labels never part again."""
    ends = F.array(F.when(F.col("more_a"), F.col("a")), F.when(F.col("more_b"), F.col("b")))
    ids = pairs.select(F.explode(ends).alias("id")).filter("id IS NOT NULL").distinct().withColumn("open", F.lit(True))
    marked = rows.join(joinable(ids, "id"), "id", "left").select("r", "e", "id", "n", (F.col("far") & F.col("open").isNotNull()).alias("far"))
    used = marked.filter("far").select("r", "e").distinct()
    return marked.join(joinable(joinable(used, "r"), "e"), ["r", "e"], "left_semi")


def differences(led: DataFrame, sets: DataFrame) -> DataFrame:
    """``led`` (r, id, n, nr, far) with extra and missing: what a set has and its leader lacks, and the other way round."""
    both = with_sets(led.withColumnsRenamed({"r": "a", "id": "b"}), sets)
    return both.select(F.col("a").alias("r"), F.col("b").alias("id"), "n", "nr", "far", F.array_except("y", "x").alias("extra"), F.array_except("x", "y").alias("missing"))


def settled(labels: DataFrame, led: DataFrame, texts: DataFrame, drawn: DataFrame, k: int, percent: int) -> DataFrame:
    """``labels`` with all links inside large buckets. led: r, id, n, nr, far, each leader compared with its sets.

    Only sets of different labels are met, so a group is done once its sets have one. First a far set of each group becomes
    a second leader, which joins up a group whose first leader is the odd one. What is left meets in its group, or by differences
    from the leader if the group is larger than ``WHOLE``: each far set with its nearest partner; in the next round those that
    have more, with eight times as many, until none has more.
    """
    spark = led.sparkSession
    members = led.select("r", "id", "far")
    for _ in range(RELEADS):
        pairs = checkpointed(second_leaders(unsettled(members, labels)))
        if pairs.isEmpty():
            return labels
        open_ = checkpointed(judged(pairs.withColumn("large", F.lit(True)), drawn, percent).filter("maybe").select("a", "b"))
        release(spark)
        labels = relabelled(labels, checkpointed(verified(open_, texts, k, percent)))
        release(spark)
    groups = checkpointed(unsettled(members, labels).groupBy("r").agg(F.count("*").alias("sets")))
    if groups.isEmpty():
        return labels
    of = lambda some: led.join(joinable(groups.filter(some), "r"), "r", "left_semi")
    whole = of(F.col("sets") <= WHOLE).select("r", F.lit(0).cast("long").alias("e"), "id", "n", "far")
    if not groups.filter(F.col("sets") > WHOLE).isEmpty():  # else no sets are needed
        wide = checkpointed(of(F.col("sets") > WHOLE))
        sets = checkpointed(sets_of(texts, wide.select("id").union(wide.select("r")).distinct(), k))
        release(spark)
        whole = whole.union(entries(differences(wide, sets), percent))
        del sets
    rows, most = checkpointed(whole), 1
    del whole
    release(spark)
    while True:
        pairs = checkpointed(hopeful_partners(rows, drawn, labels, most, percent))
        release(spark)
        more = pairs.agg(F.max(F.col("more_a") | F.col("more_b"))).first()[0]
        if more is None:
            return labels
        labels = relabelled(labels, checkpointed(verified(pairs.select("a", "b"), texts, k, percent)))
        if not more:
            return labels
        rows, most = checkpointed(still_open(rows, pairs)), most * 8
        release(spark)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; linked are sets of k-word shingles of Jaccard similarity percent / 100 or more."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(candidates(signed_sets(rows, k, percent, parts)))
    release(spark)
    sized = found.filter("a IS NULL").select("doc_id", "n_shingles", "digest")
    pairs = checkpointed(common_leaders(found.filter("a IS NOT NULL").groupBy("a", "b").agg(F.max("large").alias("large"))))
    nodes = sized.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = nodes.groupBy("digest").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.concat("digest", F.lit(b"")).alias("digest"), "b")
    exact = nodes.select("digest", F.col("doc_id").alias("a")).join(first, "digest").select("a", "b")

    release(spark)
    drawn = found.filter("a IS NULL AND bits IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits")
    met = checkpointed(judged(pairs, drawn, percent))
    release(spark)
    links = checkpointed(verified(met.filter("maybe").select("a", "b"), rows, k, percent))
    release(spark)
    labels = components(exact.union(links))
    led = met.filter("large").join(links.withColumns({"a": F.col("a") + 0, "near": F.lit(True)}), ["a", "b"], "left")
    led = checkpointed(led.select(F.col("a").alias("r"), F.col("b").alias("id"), "n", "nr", F.col("near").isNull().alias("far")))
    labels = settled(labels, led, rows, drawn, k, percent)
    return sized.join(joinable(labels.withColumnRenamed("node", "doc_id"), "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group that links connect: that of the smallest id; all columns as they are.

    Rows with equal id and text are one document, of which one row stays, with the other columns of any of them. Documents
    without an id, or with equal ids and different texts, take part under a number above 2^62 from a hash, so of a group they
    stay only if no document of its own id is in it. Texts without words are in no group."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    name, later_name = fresh_name(docs, "node"), fresh_name(docs, "later")
    odd = docs.groupBy(F.col(id_col).alias(later_name)).agg(F.count("*").alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi")).filter((F.col("n") > 1) | F.col(later_name).isNull())
    odd = checkpointed(odd.select(later_name, (F.col(later_name).isNull() | (F.col("lo") < F.col("hi"))).alias(name)))
    plain = odd.isEmpty()
    rows = docs.withColumn(name, F.col(id_col))
    if not plain:
        own = F.shiftleft(F.lit(1).cast("long"), 62) + F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0)), F.col(id_col).isNull(), h), F.lit((1 << 62) - 1))
        rows = docs.join(odd, F.col(id_col).eqNullSafe(F.col(later_name)), "left").withColumn(name, F.when(F.col(name), own).otherwise(F.col(id_col))).drop(later_name)
    later = similar_sets(rows, name, text_col, k, percent).filter("component_id < doc_id").select(F.col("doc_id").alias(later_name)).distinct()
    later = joinable(checkpointed(later), later_name)
    release(docs.sparkSession)  # what the join wrote goes before whole rows are shuffled
    kept = rows.join(later, F.col(name) == F.col(later_name), "left_anti")
    return (kept if plain else kept.dropDuplicates([name])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the links walked: for small tables.
OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM documents WHERE doc_id IN (SELECT a FROM e) UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(seen) FROM c WHERE c.node = d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
