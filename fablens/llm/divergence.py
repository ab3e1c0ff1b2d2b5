"""How the sources of a language differ in their words: terms that stand out in a source, and distances between sources.

Documents have a language and a source; a language keeps the terms (runs of letters, A-Z lower-cased) that at least
``MIN_DOCS`` of its documents have. A group (language, source) gives a kept term that it has c times the weight
p(c) = 1 + floor(10^9 (c + 5) / (N + 5 V)), where N is its count of all V kept terms; the language itself is such a group too.
All weights are whole numbers.

**Standing out.** The top terms of a group are those whose weight exceeds the language's most. Each group's terms lie in
buckets by their count (``bucket``: four leading bits). p of a bucket's largest count less the smallest weight that the
language gives a term of the bucket bounds what any of its terms reaches. Buckets are evaluated best bound first: a first
wave takes the least number that hold ``TOP`` terms; its TOP-th value is then the bar, and a second wave takes those whose
bounds are not strictly below it. No other term can reach the list, so the search ends there; only bucket statistics are
made for the rest. Lists are cut to TOP in each task before rows meet.

**Distances.** The distance of two sources is the sum of |p - p'| over all kept terms. Postings (the sources of a term and
their counts) decide the terms that both have; what only one has is summed over its histogram of counts, and what neither
has is a product. So no group is filled up with zeros.

Counting is done in Python for a task's documents together, within ``HELD`` counts, and then summed by Spark over all tasks.

Defined cases: null text, language and source are empty strings; every (language, source) of any row is a group, also one
without terms; repeated rows count each by itself; equal values are ordered by the item's bytes; an empty table gives an
empty one; only the three named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, ship, table

#: Fixed values of the contract: documents that keep a term, added count, scale, length of the lists.
MIN_DOCS, ADD, SCALE, TOP = 30, 5, 10**9, 50
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Most counts that a task holds before it hands them on.
HELD = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the documents seen so far, by group; a group's row without a term says that it occurs."""
    find = re.compile(TERM).findall
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
            own = Counter(find((text.as_py() or "").encode().lower()))  # of bytes: A-Z only
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before
            if held >= HELD:
                yield from handed()
                groups, held = {}, 0
    yield from handed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n, docs, in parts: occurrences and documents, and a row of null term for each group."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted, COUNTS)


def postings(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n: the kept terms of each group; and each group once with a null term.

    Partial counts meet once, by (lang, term).
    """
    by_term = counts.repartition("lang", "term", F.when(F.col("term").isNull(), F.col("source")))
    summed = by_term.groupBy("lang", "term", F.when(F.col("term").isNull(), F.col("source")).alias("own"), "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term", "own")
    summed = summed.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole))
    return summed.filter(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n")


def weight(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + ADD) / (total + ADD * terms)) in whole numbers of 64 bits: a long division by three decimal
    digits at a time, whose remainders stay below the divisor. Null where there is no term."""
    over = F.nullif(total + ADD * terms, F.lit(0).cast("long"))
    rest, out = count + ADD, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, over)
        rest = F.pmod(rest * 1000, over)
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact beyond the whole numbers of doubles."""
    return F.call_function("div", a, b)


def bucket(count: Column) -> Column:
    """The least count with the same four leading bits."""
    shift = F.greatest(F.length(F.bin(count)) - 4, F.lit(0))
    return count - F.pmod(count, F.pow(F.lit(2.0), shift).cast("long"))


def group_stats(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total, sources' own terms n_terms), (lang, lang_total, v): a row a group, a row a language."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("n_terms"))
    firsts = kept.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = kept.select("lang").distinct().join(firsts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v")), "lang", "left")
    return groups, langs.na.fill(0)


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms whose weight exceeds the language's most, by bounds of buckets.

    groups: lang, source, total, v, lang_total.
    """
    keys = ["lang", "source"]
    terms = kept.filter("term IS NOT NULL").withColumn("bucket", bucket(F.col("n")))
    stats = terms.groupBy(*keys, "bucket").agg(F.max("n").alias("most"), F.min("lang_n").alias("least"), F.count(F.lit(1)).alias("size")).join(groups, keys)
    bound = weight(F.col("most"), F.col("total"), F.col("v")) - weight(F.col("least"), F.col("lang_total"), F.col("v"))
    best_first = Window.partitionBy(*keys).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = checkpointed(stats.select(*keys, "bucket", "total", "v", "lang_total", "size", bound.alias("bound")).filter("bound > 0").withColumn("before", F.coalesce(F.sum("size").over(best_first), F.lit(0))))

    def evaluated(chosen: DataFrame) -> DataFrame:
        value = weight(F.col("n"), F.col("total"), F.col("v")) - weight(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        rows = terms.join(chosen.select(*keys, "bucket", "total", "v", "lang_total"), [*keys, "bucket"])
        rows = rows.select(*keys, F.col("term").alias("item"), value.alias("value")).filter("value > 0")
        order = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    first = checkpointed(evaluated(bounds.filter(F.col("before") < top)))
    bar = first.filter(F.col("rank") == top).select(*keys, F.col("value").alias("bar"))
    second = evaluated(bounds.filter(F.col("before") >= top).join(bar, keys, "left").filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))))
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    both = first.select(*keys, "item", "value").union(second.select(*keys, "item", "value"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the other sources of the language by falling distance.

    Rows of a language's pairs of sources are the result itself; per term they are made and summed within each task.
    """
    zero = weight(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    one = groups.select("lang", "source", "total", "v", "n_terms", zero.alias("zero"))
    other = one.select("lang", *[F.col(c).alias(f"{c}2") for c in ("source", "total", "zero", "n_terms")])
    # what one source has, against no count in the other
    own = kept.filter("term IS NOT NULL").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(one, ["lang", "source"])
    own = own.join(other, "lang").filter("source <> source2")
    alone = own.groupBy("lang", "source", "source2").agg(F.sum(F.col("terms") * F.abs(weight(F.col("n"), F.col("total"), F.col("v")) - F.col("zero2"))).alias("alone"))
    # what both have: the true difference for those two
    listed = kept.filter("term IS NOT NULL").join(one.select("lang", "source", "total", "v", "zero"), ["lang", "source"])
    listed = listed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", weight(F.col("n"), F.col("total"), F.col("v")).alias("p"), "zero")).alias("list"))
    pairs = listed.filter(F.size("list") > 1).select("lang", "list", F.explode("list").alias("a")).select("lang", "a", F.explode(F.filter("list", lambda b: b["source"] > F.col("a.source"))).alias("b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    shared = pairs.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("source2")).agg(F.sum(gap("a.p", "b.p") - gap("a.p", "b.zero") - gap("a.zero", "b.p") + gap("a.zero", "b.zero")).alias("shared"))
    turned = shared.select("lang", F.col("source2").alias("source"), F.col("source").alias("source2"), "shared")
    both = one.join(other, "lang").filter("source <> source2").join(alone, ["lang", "source", "source2"], "left")
    back = alone.select("lang", F.col("source2").alias("source"), F.col("source").alias("source2"), F.col("alone").alias("alone2"))
    both = both.join(back, ["lang", "source", "source2"], "left").join(shared.union(turned), ["lang", "source", "source2"], "left")
    none = F.when(F.col("v") > 0, (F.col("v") - F.col("n_terms") - F.col("n_terms2")) * gap("zero", "zero2"))
    value = F.coalesce(none, F.lit(0)) + F.coalesce("alone", F.lit(0)) + F.coalesce("alone2", F.lit(0)) + F.coalesce("shared", F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.col("source2").alias("item"), value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    kept = checkpointed(postings(term_counts(docs), min_docs))
    groups, langs = group_stats(kept)
    groups = checkpointed(groups.join(langs, "lang"))
    parts = [source_distances(kept, groups).withColumn("part", F.lit("pair")), top_terms(kept, groups, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def _weight_sql(n: str, total: str, v: str) -> str:
    return f"(1 + CAST({SCALE} AS HUGEINT) * ({n} + {ADD}) // ({total} + {ADD} * {v}))"


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= {MIN_DOCS}),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_weight_sql('coalesce(c.n, 0)', 'g.total', 'v')} AS p, {_weight_sql('k.n', 'l.total', 'v')} AS q
      FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}
"""
