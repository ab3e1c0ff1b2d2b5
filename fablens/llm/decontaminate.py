"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, probed by every training window.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A benchmark window is n consecutive words of
an item (n = 13); an item with fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit. The windows' 64-bit keys are broadcast as long as they take at most ``BROADCAST_BYTES``; what they let through
is verified by its words. More keys are joined by a shuffle of all windows, with the same result. Contaminated documents are
removed (``remove_contaminated``), or only the hit words with what stands between them (``remove_spans``). All work is
DataFrame code.

Defined cases: a null text has no words, so it is neither hit nor hits; an item without words matches nothing; rows with
equal id and equal text count once, rows with equal id and different texts give a row each; null ids are kept as an id of
their own, in the result and in removal; equal items each count; other columns are not read, and may have any names; texts of any
length take time in proportion to their words and hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, table, words, words_sql
from .wordscan import BROADCAST_BYTES, scan, sequence_key

N = 13
#: A document is contaminated if hit words are at least one in so many of its words.
SHARE = 20
#: A word before lower-casing.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """key, k, need, items: each distinct window of the benchmark with the sorted ids of the items that hold it."""
    per_item = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    windows = per_item.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")).alias("need"))
    windows = windows.groupBy("need").agg(F.sort_array(F.collect_set("item")).alias("items"))
    key = F.lit(None).cast("long")
    for k in range(1, n + 1):
        key = F.when(F.size("need") == k, sequence_key("need", "0", k)).otherwise(key)
    return windows.select(key.alias("key"), F.size("need").alias("k"), "need", "items")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, share: int = SHARE, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, spans (hit word ranges, merged), items (sorted ids), contaminated."""
    windows = benchmark_windows(items, item_id, item_text, n)
    sizes = {r["k"]: r["rows"] for r in windows.groupBy("k").agg(F.count("*").alias("rows")).collect()}  # at most n rows
    hits = scan(docs, doc_id, doc_text, windows.withColumn("width", F.col("k")), sizes, None, most_bytes)
    per_doc = hits.groupBy("doc", "rid").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "width"))).alias("found"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # the hit words, and of these the first and the last of each run
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["i"], x["i"] + x["width"] - 1)))))
    before = F.expr("slice(concat(array(-9), hit), 1, size(hit))")
    after = F.expr("slice(concat(hit, array(-9)), 2, size(hit))")
    edge = lambda other, step: F.filter(F.zip_with("hit", other, lambda p, q: F.when(q != p + step, p)), lambda p: p.isNotNull())
    out = per_doc.withColumn("hit", hit).withColumn("first", edge(before, -1)).withColumn("last", edge(after, 1))
    spans = F.zip_with("first", "last", lambda a, b: F.struct(a.alias("i"), (b + 1).alias("e")))
    out = out.select(F.col("doc").alias("doc_id"), F.col("rid").alias("text_hash"), "n_words", F.size("hit").cast("long").alias("n_hit"), spans.alias("spans"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _beside(docs: DataFrame, found: DataFrame, doc_id: str, doc_text: str, how: str, *names: str) -> DataFrame:
    """``docs`` joined with rows of ``contamination`` by id and text, under names that no column of ``docs`` has."""
    to = {c: fresh_name(docs, c) for c in ("doc_id", "text_hash", *names)}
    other = found.select(*[F.col(c).alias(n) for c, n in to.items()])
    same = F.col(doc_id).eqNullSafe(F.col(to["doc_id"])) & (F.xxhash64(F.coalesce(F.col(doc_text), F.lit(""))) == F.col(to["text_hash"]))
    return docs.join(other, same, how)


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **more) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept. The ids to drop are few, but their side is not broadcast."""
    return _beside(docs, contamination(docs, items, doc_id, doc_text, **more).filter("contaminated"), doc_id, doc_text, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **more) -> DataFrame:
    """``docs`` with the hit words taken out of the texts, each with what stands between it and the next word; rows without a
    hit are as they were, and every row stays."""
    found = contamination(docs, items, doc_id, doc_text, **more).filter("n_hit > 0")
    spans = fresh_name(docs, "spans")
    joined = _beside(docs, found, doc_id, doc_text, "left", "spans")
    # words with the gaps behind them
    own, gaps = F.regexp_extract_all(F.col(doc_text), F.lit(ANY_WORD), F.lit(0)), F.split(F.col(doc_text), ANY_WORD, -1)
    parts = F.struct(F.get(gaps, F.lit(0)).alias("head"), F.zip_with(own, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda w, g: F.concat(w, g)).alias("w"), F.col(spans).alias("s"))
    # as a lambda's argument the parts are made once a row
    cut = F.transform(F.array(parts), lambda x: F.struct(x["head"].alias("head"), x["w"].alias("w"), F.zip_with(F.concat(F.array(F.lit(0)), x["s"]["e"]), F.concat(x["s"]["i"], F.array(F.size(x["w"]))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("stay")))
    cut = F.transform(cut, lambda x: F.concat(x["head"], F.array_join(F.flatten(F.transform(x["stay"], lambda y: F.slice(x["w"], y["a"] + 1, y["b"] - y["a"]))), "")))
    return joined.withColumn(doc_text, F.when(F.col(spans).isNotNull(), F.get(cut, F.lit(0))).otherwise(F.col(doc_text))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words_sql('text')} AS w FROM benchmark),
 win AS (SELECT DISTINCT item, least(len(w), {N}) AS k, array_to_string(w[s + 1:s + {N}], ' ') AS need
         FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {N}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM win),
 dw AS (SELECT doc_id, k, s, array_to_string(w[s + 1:s + k], ' ') AS need
        FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
 hit AS (SELECT doc_id, s, dw.k AS k, item FROM dw JOIN win ON dw.need = win.need AND dw.k = win.k),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
