"""A suffix array by two-stage sorting, in array operations.

Stage one sorts directly the suffixes that are smaller than their successors (type B), by eight bytes at a time and only as
long as there are ties. Stage two induces the others (type A) by a scan over the buckets of first bytes in ascending order:
each suffix, when it is reached, puts its predecessor, if of type A, behind those already in the front of its bucket. A
bucket is scanned a batch at a time; what it puts into itself makes the next batch.

Order is exact to ``depth`` bytes at least; suffixes that agree so far are neighbours in any order. ``common_prefixes`` of
neighbours then tell equal strings.
"""

from __future__ import annotations

import numpy as np


def eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, with zeros behind the end; len(text) + 1 numbers."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text) + 1]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])  # places whose next byte is another
    at = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    inside = at < len(differs)
    place = differs[at[inside]]
    out[inside] = text[place] < text[place + 1]
    return out


def direct_sort(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by the bytes that follow them, to ``depth``."""
    last = len(words) - 1
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        key = words[np.minimum(order[tied] + d, last)]
        again = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][again], key[again]
        changed = np.ones(len(tied), bool)
        changed[1:] = (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1])
        fresh[tied] = changed
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    sorted_b = direct_sort(np.flatnonzero(small), eight(text), depth + 8)
    first = np.searchsorted(text[sorted_b], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[text[-1]].append(np.array([n - 1]))

    def put(reached: np.ndarray, here: int) -> np.ndarray:
        """Put the predecessors of type A to their buckets; return those of the bucket at hand."""
        before = reached[reached > 0] - 1
        before = before[~small[before]]
        bucket = text[before]
        order = np.argsort(bucket, kind="stable")
        before, bucket = before[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        own = before[:0]
        for s, part in zip(starts, np.split(before, starts[1:]), strict=True) if len(starts) else ():
            if bucket[s] == here:
                own = part
            else:
                fronts[bucket[s]].append(part)
        return own

    out = []
    for c in range(256):
        batch = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        while len(batch):
            out.append(batch)
            batch = put(batch, c)
        tail = sorted_b[first[c] : first[c + 1]]
        if len(tail):
            out.append(tail)
            put(tail, c)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes from a and from b (places of ``eight``'s numbers) have in common, ``most`` at most."""
    out, alive, last = np.zeros(len(a), np.int64), np.arange(len(a)), len(words) - 1
    for d in range(0, most, 8):
        differ = words[np.minimum(a[alive] + d, last)] ^ words[np.minimum(b[alive] + d, last)]
        out[alive] += sum((differ >> np.uint64(64 - 8 * n)) == 0 for n in range(1, 8)) + (differ == 0)
        alive = alive[differ == 0]
    return np.minimum(out, np.minimum(most, last - np.maximum(a, b)))
