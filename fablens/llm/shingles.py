"""Sets of hashed word shingles, computed for a whole text at a time with array operations.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Shingles are k consecutive words; a text with fewer words, but
not none, has its whole sequence as one. Words and shingles are known by 64-bit hashes: two different shingles of one pair of
texts are taken for the same with a probability of about 2**-64 each, whatever the texts' form.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP[3]
    h = (h ^ (h >> np.uint64(29))) * _STEP[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word. The words' bytes are laid out in blocks of eight, and each block is mixed with its number before
    blocks are added, so no algebra of the bytes carries over to the sum, whatever the words' length."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    blocks = (lengths + 7) >> 3
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * 8, np.uint8)
    padded[np.arange(lengths.sum()) + np.repeat(first * 8 - (np.cumsum(lengths) - lengths), lengths)] = data[inside[1:-1]]
    number = (np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1).astype(np.uint64)
    values = mix((padded.view("<u8") ^ _STEP[1]) + number * _STEP[0])
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP[2])


def shingle_set(text: str | None, k: int = 3) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix(h * _STEP[2] + w[j : len(w) - n + 1 + j])
    return np.unique(h)
