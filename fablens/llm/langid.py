"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed letter trigrams. A document's trigrams are taken as drawn from a mixture of
languages; expectation-maximisation estimates the proportions, and the set of languages is the one with the best
likelihood less a penalty for each language beyond the first (Schwarz's, times ``PENALTY``, since overlapping trigrams are
not independent). The prediction is the largest share of that set; the score is its share in the mixture of all.

The distributions are learned from a bounded sample of labelled rows: every row whose id's hash falls below
``SAMPLE_ROWS`` divided by the number of labelled rows or ``LEAST_ROWS`` divided by that of its language, whichever is more.
So the sample is about ``SAMPLE_ROWS`` rows at any size of the corpus and up to ``LEAST_ROWS`` more for each rare language;
whole texts are read. A label that the sample shows no letter of is learned from all of its rows, so every label that has a
letter is learned. The model has ``BUCKETS`` numbers a language.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing is labelled;
equal likelihoods go to the alphabetically first language; each input row gives one output row, so repeated rows stay; a
null id is never learned from and not held out; columns other than the named ones are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

BITS = 14
BUCKETS = 1 << BITS
SAMPLE_ROWS = 8_000
LEAST_ROWS = 1_000
PENALTY = 4.0
ROUNDS = 12
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case form if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(text: str) -> np.ndarray | None:
    """Counts of a text's trigrams by bucket, None without a letter. Runs of non-letters count as they stand, as spaces."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[points]
    if (letters == 32).all():
        return None
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h[(a | b | c) != 32] >> np.uint32(32 - BITS), minlength=BUCKETS)  # three non-letters say nothing


def mixture(counts: np.ndarray, probs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log likelihood: counts (k), probs (k by languages)."""
    total = counts.sum()
    share = np.full(probs.shape[1], 1 / probs.shape[1])
    before = -np.inf
    for _ in range(rounds):
        mixed = probs @ share
        now = float(counts @ np.log(mixed))
        if now - before < 1e-3:
            break
        before = now
        share = share * ((counts / mixed) @ probs) / total
    return share, float(counts @ np.log(probs @ share))


def infer(counts: np.ndarray, probs: np.ndarray) -> tuple[int, float, list[int]]:
    """(index of the language, its share, the selected set) from a document's counts by bucket."""
    found = np.flatnonzero(counts)
    c, p = counts[found].astype(float), probs[found]
    single = c @ np.log(p)
    best = int(single.argmax())
    chosen, value = [best], float(single[best])
    if p.shape[1] == 1:
        return best, 1.0, chosen
    share, full = mixture(c, p)
    cost = PENALTY * 0.5 * np.log(c.sum() + 1)
    if full - value > cost:
        order = np.argsort(-share, kind="stable")
        for m in range(2, p.shape[1] + 1):
            some = order[:m].tolist()
            part, likelihood = mixture(c, p[:, some])
            if likelihood - cost * (m - 1) > value:
                chosen, value, best = some, likelihood - cost * (m - 1), some[int(part.argmax())]
    return best, float(min(1.0, max(0.0, share[best]))), chosen


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram distributions (buckets by languages), from a bounded sample of rows."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    tally = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter("id IS NOT NULL AND lang IS NOT NULL").groupBy("lang").count()
    rows_of = {r["lang"]: r["count"] for r in tally.collect()}
    wide = 1 << 30
    rate = sample_rows / max(1, sum(rows_of.values()))
    most = [(lang, int(wide * min(1.0, max(rate, least_rows / n)))) for lang, n in rows_of.items()]
    limits = labelled.sparkSession.createDataFrame(most, "lang string, most long")
    sample = rows.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(wide)) < F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = trigrams(text.as_py())
                if got is not None:
                    total[lang] = total[lang] + got if lang in total else got
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["lang", "bucket", "n"])

    # at most BUCKETS rows for each language
    def counted(some: DataFrame):
        return some.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()

    model = counted(sample)
    unseen = [x for x in most if x[1] < wide and x[0] not in set(model["lang"])]
    if unseen:
        rest = labelled.sparkSession.createDataFrame(unseen, limits.schema)
        model = pd.concat([model, counted(rows.join(F.broadcast(rest), "lang", "left_semi"))])
    langs = sorted(model["lang"].unique())
    counts = np.zeros((BUCKETS, max(1, len(langs))))
    for i, lang in enumerate(langs):
        part = model[model["lang"] == lang]
        counts[part["bucket"].to_numpy(), i] = part["n"].to_numpy()
    overall = counts.sum(1, keepdims=True) + 1e-2
    overall /= overall.sum()
    # what a language has not shown falls back on the mean of all
    return langs, (counts + 200.0 * overall) / (counts.sum(0, keepdims=True) + 200.0)


def identify(docs: DataFrame, langs: list[str], probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (the selected set)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(probs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            pred, score, sets = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                counts = trigrams(text) if text and langs else None
                if counts is None:
                    pred.append(UNKNOWN), score.append(0.0), sets.append([])
                    continue
                best, share, chosen = infer(counts, p)
                pred.append(langs[best]), score.append(share), sets.append([langs[i] for i in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def keep_known(docs: DataFrame, langs: list[str], probs: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und``, all columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(probs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            known = []
            for text in batch.column(at):
                text = text.as_py()
                counts = trigrams(text) if text and langs else None
                known.append(counts is not None and langs[infer(counts, p)[0]] != UNKNOWN)
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out; predict all."""
    langs, probs = learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    return identify(docs, langs, probs)


def op7(spark, sf_dir: str) -> DataFrame:
    return predict_documents(table(spark, sf_dir, "documents")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
