"""One scan over all word windows of all texts, matched against a table of word sequences.

Everything here is DataFrame code, so the scan, the window hashing and the probe of the broadcast keys run in one generated
loop; only windows whose key is in the table and one row per document leave it, with the words of the window and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words
from .components import joinable

#: Bytes that a broadcast key takes, and up to which keys are broadcast. More keys are joined by shuffling the windows.
KEY_BYTES, BROADCAST_BYTES = 40, 128 << 20
#: Words of a text that are windowed at once where all windows are shuffled.
PIECE = 4096


def sequence_key(array: str, start: str, k: int):
    """Hash of the k words of column ``array`` that begin at ``start`` (from 0)."""
    return F.xxhash64(*[F.get(F.col(array), F.expr(f"{start} + {j}")) for j in range(k)])


def scan(docs: DataFrame, id_col: str, text_col: str, sequences: DataFrame, sizes: dict[int, int], longest: int | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Match the word windows of ``docs`` against ``sequences``.

    docs       id and text columns; rows with equal id and text count once, other rows with equal ids stay apart
    sequences  key (``sequence_key`` of the first words), k (how many), need (array of words that must stand there), and
               any payload columns
    sizes      the number of rows for each k
    longest    the most words that must stand anywhere, if more than the largest k
    most_bytes up to which the keys are broadcast

    Returns ``doc, rid, n_words, i`` and the payload: per document one row with i = -1 and a null payload, and one row
    for each match of a sequence at word i.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid"), words(F.col(text_col)).alias("words"))
    base = base.select("doc", "rid", "words", F.size("words").alias("n_words"))
    payload = [c for c in sequences.columns if c not in ("key", "k", "need")]
    side = sequences.withColumnsRenamed({"key": "seq_key", "k": "seq_k"})
    lengths = sorted(sizes)
    if not lengths:
        return base.select("doc", "rid", "n_words", F.lit(-1).alias("i"), *[F.lit(None).cast(sequences.schema[c].dataType).alias(c) for c in payload])
    longest = longest or lengths[-1]
    small = sum(sizes.values()) * KEY_BYTES <= most_bytes
    if small:
        base = base.withColumn("at", F.lit(0))
    else:  # all windows leave the scan, so a long text goes in pieces, to be in no task's memory with all of its windows
        base = base.select("doc", "rid", "words", "n_words", F.explode(F.expr(f"sequence(0, greatest(0, n_words - 1), {PIECE})")).alias("at"))
        base = base.select("doc", "rid", F.expr(f"slice(words, at + 1, {PIECE + longest - 1})").alias("words"), "n_words", "at").repartition("doc", "rid", "at")
    # the row -1 appears once per document
    last = f"size(words) - {lengths[0]}" if small else f"least(size(words) - {lengths[0]}, {PIECE} - 1)"
    reach = F.expr(f"CASE WHEN at = 0 THEN sequence(-1, greatest(-1, {last})) WHEN {last} >= 0 THEN sequence(0, {last}) ELSE cast(array() AS array<int>) END")
    rows = base.select("doc", "rid", "words", "n_words", "at", F.explode(reach).alias("i"))
    there = {k: (F.col("i") >= 0) & (F.col("at") + F.col("i") + k <= F.col("n_words")) for k in lengths}
    for k in lengths:
        rows = rows.withColumn(f"key{k}", F.when(there[k], sequence_key("words", "i", k)))
    if small:
        some = F.col("i") < 0
        for k in lengths:
            keys = side.filter(F.col("seq_k") == k).select(F.col("seq_key").alias(f"has{k}")).distinct()
            rows = rows.join(F.broadcast(keys), F.col(f"key{k}") == F.col(f"has{k}"), "left")
            there[k] = F.col(f"has{k}").isNotNull()
            some = some | there[k]
        rows = rows.filter(some)
    one = [F.when(there[k], F.struct(F.lit(k).alias("k"), F.col(f"key{k}").alias("key"))) for k in lengths]
    hits = rows.select("doc", "rid", "n_words", F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("at") + F.col("i")).alias("i"), F.expr(f"slice(words, greatest(i, 0) + 1, {longest})").alias("here"), F.filter(F.array(*one), lambda x: x.isNotNull()).alias("x"))
    hits = hits.select("doc", "rid", "n_words", "i", "here", F.explode_outer("x").alias("x"))
    # rows without a key are spread by their document
    hits = hits.select("doc", "rid", "n_words", "i", "here", F.col("x.k").alias("k"), F.coalesce("x.key", F.xxhash64("doc", "rid")).alias("key"))
    same = (F.col("key") == F.col("seq_key")) & (F.col("k") == F.col("seq_k")) & (F.expr("slice(here, 1, size(need))") == F.col("need"))
    out = hits.join(joinable(side, "seq_key"), same, "left").filter((F.col("i") < 0) | F.col("seq_key").isNotNull())
    return out.select("doc", "rid", "n_words", "i", *payload)
