"""BPE encoding and decoding of documents, with content-defined chunk reuse (see ``bpe``).

Defined cases: a null text is the empty text, of no tokens; every input row gives one output row, so repeated rows and
null ids stay; columns other than the named ones are not read. Memory: one Arrow batch and
the bounded memories of ``bpe``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import ship, table

FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded: what the ids decode to."""
    path = path or tokenizer_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode_by_chunks(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text: ``encode_documents`` without moving the ids to the JVM."""
    path = path or tokenizer_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):  # one text at a time is a Python string
                ids = bpe.encode_by_chunks(text.as_py() or "")
                listed = ids.tolist()
                n.append(len(listed))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, listed)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
