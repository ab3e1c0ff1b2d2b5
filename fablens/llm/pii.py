"""Personal data by bootstrapped contextual extraction.

Base      Expressions find e-mail addresses, IP addresses, payment cards and phone numbers, with checks of their parts.
Patterns  These seed entities stand in lexical contexts: the two words before them, and the two words behind. A seed is an
          instance by its whole text, with spaces and brackets, digits or none; of seeds within one another only the
          outermost, and of those that begin together the longest. Other instances are identifier-like tokens: with a digit,
          or assigned to a name (behind = or :). Tokens that are long hexadecimal numbers are seeds of kind ``secret``.
Scoring   Seeds have confidence 1 in their kind. In each round a pattern's score for a kind is the mean confidence of its
          distinct instances, if enough of them are confident, and an instance's confidence is 1 less the product of
          1 - score over its patterns.
Discovery Tokens in the context of a pattern that ends with a high score are identifiers too: of kind ``id_`` and the kind of
          the best such pattern (equal scores: the first by name).

A context is read from what stands between a match and the last but one match before it, or the next but one behind it, of
the same expression, ``WINDOW`` code points at most; so a word that is cut there counts as far as it goes.

All of it is DataFrame code over the whole corpus; only the spans and the identifier-like tokens leave the scan of the texts.

Defined cases: a null text is empty; rows with equal id and text count once, rows with equal id and different texts give a
row each; a null id stays; places are code points; columns other than the named ones are not read, and may have any names;
texts of any number of matches take linear time, in ``redact`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, table

#: kind -> expression. Possessive where nothing may be given back, and looking behind where a match can only begin at the
#: begin of a run: the same matches, in linear time and without recursion.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What ends a token; a token with a digit, or behind = or : without one.
_END = r"\s\"'<>()\[\]{},;|"
TOKEN = rf"(?<![^{_END}])[^{_END}0-9]*+[0-9][^{_END}]*+|(?<=[=:] ?[\"']?)[^{_END}0-9=:]++(?![^{_END}])"
#: A token that is a seed.
SECRET = "^[0-9a-f]{32,}$"
BEFORE = r"(\S+)\s+(\S*\p{L}\S*|=|:)[\s\"'(<]*$"
AFTER = r"^[\"')>\]},;|]*\s+(\S*\p{L}\S*)\s+(\S*\p{L}\S*)"
WINDOW = 256
ROUNDS, SUPPORT, CONFIDENT, SCORE = 3, 3, 0.5, 0.8


def _matches(t: str, o: int, kind: str, pattern: str, cond: Column, df: DataFrame) -> DataFrame:
    """Adds column ``kind``: a pattern's matches m with their number i, the width of the gap before each, and what stands
    before and after it (of the gap, the neighbouring match and the gap beyond that)."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(cond, F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(F.col(t), pattern, -1)).otherwise(empty))
    # the arrays are arguments, never looked up from within a lambda: there they could be made anew for each element
    pairs = "zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> struct(m, g))"
    past = "zip_with(slice(concat(array(''), _m), 1, size(_m)), slice(concat(array(''), _g), 1, size(_m)), (m, g) -> struct(m, g))"
    next_ = "zip_with(slice(_g, 2, size(_m)), slice(concat(_m, array('')), 2, size(_m)), (g, m) -> struct(g, m))"
    beyond = "slice(concat(_g, array('')), 3, size(_m))"
    before = f"right(concat(right(y.g, {WINDOW}), right(y.m, {WINDOW}), right(x.g, {WINDOW})), {WINDOW})"
    after = f"left(concat(left(x.n.g, {WINDOW}), left(x.n.m, {WINDOW}), left(y, {WINDOW})), {WINDOW})"
    zipped = f"zip_with({pairs}, {past}, (x, y) -> struct(x.m AS m, x.g AS g, {before} AS before))"
    zipped = f"zip_with(zip_with({zipped}, {next_}, (x, n) -> struct(x.m AS m, x.g AS g, x.before AS before, n AS n)), {beyond}, (x, y) -> struct(x.m AS m, x.g AS g, x.before AS before, {after} AS after))"
    return df.withColumn(kind, F.expr(f"transform({zipped}, (x, i) -> struct({o} AS o, '{kind}' AS kind, i AS i, x.m AS m, length(x.g) AS gap, x.before AS before, x.after AS after))")).drop("_m", "_g")


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> IF(i % 2 = 0, cast(d AS int), cast(d AS int) * 2 - IF(cast(d AS int) > 4, 9, 0))), 0, (a, v) -> a + coalesce(v, 0)) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, rid, o, kind, s, e of base spans and, of kind token, of identifier-like tokens; their text m, their patterns
    (null: no instance) and, of seeds, the kind in ``seed``.

    A text's matches become rows, whose places are sums of the widths before them, so a text of any number of matches is
    handled in linear time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("rid"), text.alias("t"))
    df = df.withColumn("digits", F.col("t").rlike("[0-9]"))
    for o, (kind, pattern) in enumerate(KINDS.items()):
        # an address needs no digit
        cond = F.col("t").contains("@") if kind == "email" else F.col("digits") & (F.col("t").contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True))
        df = _matches("t", o, kind, pattern, cond, df)
    df = _matches("t", len(KINDS), "token", TOKEN, F.col("digits") | F.col("t").rlike("[=:]"), df)
    rows = df.select("doc", "rid", F.explode(F.concat(*KINDS, "token")).alias("x")).select("doc", "rid", "x.*").distinct()
    rows = rows.repartition("doc", "rid")  # for both windows
    upto = Window.partitionBy("doc", "rid", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("m")).over(upto)).withColumn("s", F.col("e") - F.length("m"))
    fine = F.col("kind") == "token"
    for kind, valid in _VALID.items():
        fine = fine | ((F.col("kind") == kind) & F.expr(valid))
    rows = rows.filter(fine)
    base_end = F.when(F.col("kind") != "token", F.col("e"))
    place = Window.partitionBy("doc", "rid").orderBy("s")
    rows = rows.withColumn("open", F.max(base_end).over(place.rangeBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("longest", F.max(base_end).over(place.rangeBetween(0, 0)))
    # what begins inside a seed without beginning it is a part of that seed
    outer = F.coalesce(F.col("open") <= F.col("s"), F.lit(True))
    rows = rows.filter((F.col("kind") != "token") | outer)
    # a seed is its own instance; the token that begins with it is a part of it, or holds it
    token = F.col("kind") == "token"
    instance = F.when(token, F.col("longest").isNull()).otherwise(outer & (F.col("e") == F.col("longest")))
    words = lambda text, expression: [F.nullif(F.regexp_extract(text, expression, n), F.lit("")) for n in (1, 2)]
    sides = [F.lower(F.concat(F.concat_ws(" ", *words("before", BEFORE)), F.lit(" _"))), F.lower(F.concat(F.lit("_ "), F.concat_ws(" ", *words("after", AFTER))))]
    patterns = F.when(instance, F.filter(F.array(*sides), lambda x: F.length(x) > 2))
    seed = F.when(instance, F.when(~token, F.col("kind")).when(F.col("m").rlike(SECRET), "secret"))
    return rows.select("doc", "rid", "o", "kind", "s", "e", "m", patterns.alias("patterns"), seed.alias("seed"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, score from the distinct (pattern, m, seed) of a corpus; seed: the kind of a seed, else null."""
    seeds = edges.filter("seed IS NOT NULL").groupBy("m").agg(F.min("seed").alias("kind")).withColumn("conf", F.lit(1.0))
    seeds = checkpointed(seeds)
    links = checkpointed(edges.select("pattern", "m").distinct())
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    instances = seeds
    for n in range(rounds):
        judged = links.join(joinable_text(instances, "m"), "m").groupBy("pattern", "kind").agg(F.sum("conf").alias("sum"), F.count_if(F.col("conf") >= CONFIDENT).alias("good"))
        judged = judged.filter(F.col("good") >= support).join(joinable_text(sizes, "pattern"), "pattern")
        patterns = checkpointed(judged.select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score")))
        if n + 1 < rounds:
            reached = links.join(joinable_text(patterns, "pattern"), "pattern").groupBy("m", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("conf"))
            others = reached.join(joinable_text(seeds.select("m"), "m"), "m", "left_anti")
            instances = checkpointed(seeds.select("m", "kind", "conf").union(others.select("m", "kind", "conf")))
    return patterns


def joinable_text(df: DataFrame, key: str) -> DataFrame:
    """``components.joinable`` for a string key."""
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, least: float = SCORE) -> DataFrame:
    """doc, rid (hash of the text), s, o, kind, e: a row for each span, o being 0 to 3 for base spans."""
    marks = checkpointed(scan(docs, id_col, text_col))
    instances = marks.filter("patterns IS NOT NULL").select("doc", "rid", "o", "kind", "s", "e", "m", "seed", F.explode("patterns").alias("pattern"))
    strong = score_patterns(instances.groupBy("pattern", "m").agg(F.min("seed").alias("seed")), rounds, support).filter(F.col("score") >= least)
    strong = strong.groupBy("pattern").agg(F.min(F.struct((-F.col("score")).alias("minus"), "kind")).alias("best"))
    found = instances.filter("kind = 'token'").join(joinable_text(strong, "pattern"), "pattern")
    found = found.groupBy("doc", "rid", "s", "o", "e").agg(F.min("best").alias("best")).select("doc", "rid", "s", "o", F.concat(F.lit("id_"), F.col("best.kind")).alias("kind"), "e")
    return marks.filter("kind <> 'token'").select("doc", "rid", "s", "o", "kind", "e").union(found)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per document: doc_id, text_hash, base and found: arrays of (s, o, kind, e) in order."""
    one = F.struct(F.col("s").cast("int").alias("s"), "o", "kind", F.col("e").cast("int").alias("e"))
    of = lambda cond: F.sort_array(F.collect_list(F.when(cond, one)))
    spans = all_spans(docs, id_col, text_col, **more).groupBy("doc", "rid").agg(of(F.col("o") < len(KINDS)).alias("base"), of(F.col("o") >= len(KINDS)).alias("found"))
    spans = spans.withColumnsRenamed({"doc": "_doc", "rid": "_rid"})
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid")).distinct()
    out = rows.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left")
    none = F.array().cast("array<struct<s: int, o: int, kind: string, e: int>>")
    return out.select(F.col("doc").alias("doc_id"), F.col("rid").alias("text_hash"), F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that overlap, in a run, one with the first's kind.
    Other texts are as they are, and every row stays."""
    place = Window.partitionBy("doc", "rid").orderBy("s", "o")
    spans = all_spans(docs, id_col, text_col, **more).repartition("doc", "rid")
    spans = spans.withColumn("reach", F.max("e").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.coalesce((F.col("s") >= F.col("reach")).cast("int"), F.lit(1))).over(place))
    runs = spans.groupBy("doc", "rid", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("kind", F.struct("s", "o")).alias("kind"))
    to = {c: fresh_name(docs, c) for c in ("doc", "rid", "runs")}
    runs = runs.groupBy("doc", "rid").agg(F.sort_array(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "kind"))).alias("runs")).withColumnsRenamed(to)
    joined = docs.join(runs, F.col(id_col).eqNullSafe(F.col(to["doc"])) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(to["rid"])), "left")
    # as a lambda's argument the characters are made once a row
    row = F.array(F.struct(F.split(F.col(text_col), "").alias("c"), F.col(to["runs"]).alias("r"), F.length(text_col).alias("n")))

    def cut(x: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), x["r"]["e"])
        ends = F.concat(x["r"]["s"], F.array(x["n"]))
        marks = F.concat(F.transform(x["r"], lambda y: F.concat(F.lit("["), F.upper(y["kind"]), F.lit("]"))), F.array(F.lit("")))
        kept = F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(x["c"], a + 1, b - a), ""))
        return F.array_join(F.zip_with(kept, marks, lambda a, b: F.concat(a, b)), "")

    text = F.when(F.col(to["runs"]).isNotNull(), F.get(F.transform(row, cut), F.lit(0))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "found"))).alias("spans"))
