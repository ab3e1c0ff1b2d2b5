"""Token files of directly addressable codes.

An id is split into bytes from the low end. Level 0 holds the lowest byte of every id and a bitmap that says whether the id
goes on; level 1 holds the next byte of those that go on, with a bitmap of its own, and so forth. A rank directory counts
the bitmap's ones before every 512 bits, so token i is read by one look-up a level: if its bit is set, its place on the
next level is the number of ones before it. No block is decoded to read one token.

A file is a sequence of blocks of whole documents in ascending doc_id order. A block row holds shard and block (their order
is the order of ids), the documents' ids and lengths, n_tokens, and the code as one binary value. Spark's writer stores the
rows, so any file system that Spark can write will do, and a lost task writes its shard again.

Block layout, little-endian: uint32 magic, uint32 number of levels, uint64 n; then for each level n_bytes x uint8, the
bitmap padded to 64 bytes, and uint32 counts of the ones before each 512 bits.

Defined cases: a null text has no ids of its own but still its end id; rows with equal doc_id stay side by side, ordered by
text; null doc_ids come first; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import checkpoint_folder, ship, table
from .encode import tokenizer_path

MAGIC = 0x31434144
#: A block is closed once it holds so many ids; one longer document makes a block of its own.
BLOCK_TOKENS = 1 << 17
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_HEAD = np.dtype([("magic", "<u4"), ("levels", "<u4"), ("n", "<u8")])


def pack(ids: np.ndarray) -> bytes:
    """The code of an array of unsigned ids."""
    out, rest, levels = [], np.asarray(ids, "<u4"), 0
    while levels == 0 or len(rest):
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        ones = _ONES[bits].reshape(-1, 64).sum(1, dtype="<u4") if len(bits) else np.zeros(0, "<u4")
        ranks = np.cumsum(ones, dtype="<u4") - ones
        out += [rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[on] >> np.uint32(8)
        levels += 1
    return np.array([(MAGIC, levels, len(ids))], _HEAD).tobytes() + b"".join(out)


class Code:
    """A packed block: ``code[i]`` reads one id, ``code.slice(a, b)`` a range."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a block of token codes")
        self.n, self.levels, at, n = int(head["n"]), [], _HEAD.itemsize, int(head["n"])
        for _ in range(int(head["levels"])):
            low = np.frombuffer(data, np.uint8, n, at)
            at += n
            size = -(-n // 512) * 64
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            ranks = np.frombuffer(data, "<u4", size // 64, at)
            at += ranks.nbytes
            self.levels.append((low, bits, ranks))
            n = self._rank(len(self.levels) - 1, n)

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        if i == 0:
            return 0
        k = (i - 1) // 512
        at = k * 64
        whole, part = divmod(i - k * 512, 8)
        ones = int(ranks[k]) + int(_ONES[bits[at : at + whole]].sum(dtype=np.int64))
        return ones + (int(_ONES[bits[at + whole] & ((1 << part) - 1)]) if part else 0)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << 8 * level
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids a to b - 1."""
        low, bits, _ = self.levels[level]
        out = low[a:b].astype("<u4")
        on = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[(a & 7) : (a & 7) + b - a].astype(bool)
        if level + 1 < len(self.levels) and on.any():
            c = self._rank(level, a)
            out[on] |= self.slice(c, c + int(on.sum()), level + 1) << np.uint32(8)
        return out


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("code", pa.binary())])
_DDL = "shard int, block long, doc_ids array<long>, lengths array<long>, n_tokens long, code binary"


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of all documents' ids, shards and blocks in ascending doc_id order."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, block = load(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], bpe.dtype)
        docs_, arrays, size = [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x for pair in arrays for x in (pair, end)])
            row = {"shard": shard, "block": block, "doc_ids": docs_, "lengths": [len(x) + 1 for x in arrays], "n_tokens": len(ids), "code": pack(ids)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                docs_.append(doc)
                arrays.append(ids)
                size += len(ids) + 1
                if size >= block_tokens:
                    yield closed()
                    docs_, arrays, size, block = [], [], 0, block + 1
        if docs_:
            yield closed()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(run, _DDL)


def write_tokens(docs: DataFrame, folder: str, **options) -> None:
    token_blocks(docs, **options).write.mode("overwrite").parquet(folder)


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block, base: ids in all blocks before. A shard's blocks are summed in its own window; only the totals of
    shards, one row for each range partition, meet in one."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("shard", "block", within.alias("within")).join(totals.select("shard", before.alias("before")), "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("base"))


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, read from blocks."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, docs, lengths, data = (batch.column(c)[row].as_py() for c in ("shard", "block", "doc_ids", "lengths", "code"))
                code, starts = Code(data), np.concatenate([[0], np.cumsum(lengths)]).astype(int)
                crc = [zlib.crc32(code.slice(a, b).tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = blocks.select("shard", "block", "doc_ids", "lengths", "code").mapInArrow(run, "shard int, block long, doc_id long, start long, n_tokens long, ids_crc32 long")
    # the codes stay where they are read; only a short row per document meets the blocks' places
    based = read.join(block_starts(blocks.select("shard", "block", "n_tokens")), ["shard", "block"])
    return based.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark.read.parquet(folder))
