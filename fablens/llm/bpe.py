"""Exact byte-level BPE encoding from a tokenizer file, with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks that depend on content only, so documents that share passages share
chunks. A pre-token never holds a space or newline that follows a character which isn't white space; the text between two
such places ("settled cuts") is encoded alike in any context. The part of a chunk between its first and last settled cut is
therefore encoded once and reused. The joins between chunks are repaired: the end of one chunk and the beginning of the
next are encoded together, and the stretch grows by whole chunks until it ends at settled cuts, where both sides agree with
the encoding of the whole text.

The memory of chunks is bounded, is emptied when full, and serves all documents that a Python worker meets.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Bytes of chunk texts remembered in a worker; a chunk is about 2^CHUNK_BITS bytes.
CHUNK_BYTES, CHUNK_BITS, WINDOW = 24 << 20, 10, 32
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_chars() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Bpe:
    """The encoder of a byte-level BPE file in the tokenizers library's JSON format.

    Merging runs in tiktoken's core over the same vocabulary, which is right if ids rise in order of the merges; this is
    checked, and files of another kind go to the tokenizers library itself. Special tokens found in a text become their
    ids, as in that library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(x["id"] for x in added)]) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        chars = _byte_chars()
        special = {x["content"]: x["id"] for x in added}
        pieces: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = token.encode() if token in special else bytes(chars[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranked = [vocab[a + b] for a, b in merges]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain &= all(a < b for a, b in zip(ranked, ranked[1:], strict=False)) and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        plain &= not model.get("dropout") and not model.get("ignore_merges") and not any(re.search(r"\s", t) for t in special)
        self.plain = bool(plain)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = {t: np.array([i], self.dtype).tobytes() for t, i in special.items()}
        if self.plain:
            import public_tokenizers
            import tiktoken

            ranks = {pieces[i]: i for t, i in vocab.items() if t not in special}
            self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.core = Tokenizer.from_file(path)
        self.chunks: dict[str, tuple[str, bytes, str] | None] = {}
        self.chunk_bytes = 0

    def _raw(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        return np.array(self.core.encode_ordinary(text) if self.plain else self.core.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def bytes(self, text: str) -> bytes:
        """Ids of a text, as bytes of ``dtype``."""
        if not self.plain:
            return self._raw(text)
        if self.special is None or "<" not in text and not self.special.search(text):
            return self._raw(text)
        return b"".join(self.special_ids.get(part) or self._raw(part) for part in self.special.split(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.bytes(text), self.dtype)

    def _parts(self, chunk: str) -> tuple[str, bytes, str] | None:
        """(before the first settled cut, ids between, from the last settled cut on), or None without a cut."""
        found = self.chunks.get(chunk, False)
        if found is not False:
            return found
        first = _CUT.search(chunk)
        if first is None:
            parts = None
        else:
            a, b = first.start(), len(chunk)
            while not (chunk[b - 1 : b] and chunk[b - 1] in " \n" and not chunk[b - 2].isspace()):
                b -= 1
            parts = chunk[:a], self.bytes(chunk[a : b - 1]), chunk[b - 1 :]
        if len(chunk) <= 1 << 16:
            self.chunk_bytes += len(chunk) * 3
            if self.chunk_bytes > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = len(chunk) * 3
            self.chunks[chunk] = parts
        return parts

    def encode_by_chunks(self, text: str) -> np.ndarray:
        """``encode`` by way of content-defined chunks and repaired joins."""
        if not self.plain:
            return self.encode(text)
        out, open_ = [], []
        for chunk in chunks(text):
            parts = self._parts(chunk)
            if parts is None:
                open_.append(chunk)
                continue
            head, body, tail = parts
            out += [self.bytes("".join([*open_, head])), body]
            open_ = [tail]
        out.append(self.bytes("".join(open_)))
        return np.frombuffer(b"".join(out), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")

    @functools.cached_property
    def decimals(self) -> list[str]:
        return [str(i) for i in range(self.size)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a file, one per worker."""
    return Bpe(path)


_TABLE = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunks(text: str, bits: int = CHUNK_BITS) -> list[str]:
    """Cut a text where the hash of the last 32 bytes has ``bits`` zero bits, never inside a character."""
    raw = text.encode()
    if len(raw) <= WINDOW:
        return [text] if text else []
    data = np.frombuffer(raw, np.uint8)
    h, width, factor = _TABLE[data], 1, 0x9E3779B1
    while width < WINDOW:  # doubling: the hash of 2w bytes from those of w bytes
        h = h[:-width] * np.uint32(pow(factor, width, 1 << 32)) + h[width:]
        width *= 2
    ends = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + WINDOW
    ends = ends[ends < len(raw)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    bounds = [0, *ends.tolist(), len(raw)]
    return [raw[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]
