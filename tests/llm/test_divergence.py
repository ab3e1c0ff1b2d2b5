"""The source divergence audit against a plain version."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fablens.llm import divergence

TEXT = "doc_id long, text string, lang string, source string, item string"


def plain(rows, min_docs, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source, _ in rows]
    seen, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        own[lang, source].update(words)
        total[lang].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in total:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        weights = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q = weights(total[lang])
        p = {s: weights(c) for (g, s), c in own.items() if g == lang}
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def got(df, *args):
    return sorted(tuple(r) for r in divergence.audit(df, *args).collect())


def rows(seed=3, n=240):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "b", "é", "Z", None])
        words = [f"w{chr(97 + int(r.expovariate(0.3)) % 26)}{'x' if source == 'a' else ''}" for _ in range(r.randint(0, 40))]
        out.append((i, " ".join(words).upper() if i % 3 else "É1É-" + " ".join(words), lang, source, "other"))
    out += [(500, "only one here", "fr", "a", ""), (501, None, "fr", "b", ""), (502, "", "fr", None, ""), (503, None, "xx", "a", "")]
    return out + out[:20] + [(None, "wa wb", None, None, None)] + [(900 + i, "hot " * 50, "en", "a", "") for i in range(60)]


def test_audit_equals_a_plain_run(spark):
    data = rows()
    df = spark.createDataFrame(data, TEXT).repartition(3)
    for min_docs, top in ((30, 50), (3, 4), (1, 1)):
        want = plain(data, min_docs, top)
        assert got(df, min_docs, top) == want and {x[2] for x in want} == {"pair", "term"}
    assert got(df.filter("false")) == []


def test_waves_and_handed_counts(spark, monkeypatch):
    """Many terms of many counts, so that bounds leave buckets out; and counts handed on often."""
    r = random.Random(8)
    data = [(i, " ".join(chr(97 + r.randrange(26)) + chr(97 + int(26 * r.random() ** 3)) for _ in range(120)), "en", f"s{i % 3}", "") for i in range(300)]
    df = spark.createDataFrame(data, TEXT)
    monkeypatch.setattr(divergence, "HELD", 500)
    assert got(df, 2, 5) == plain(data, 2, 5)


def test_weights_are_exact(spark):
    cases = [(0, 0, 1), (10**12, 3 * 10**12, 7), (10**15, 10**15, 1), (123456789, 987654321987, 54321), (5, 17, 0), (7, 7, 1)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    out = df.select("c", "n", "v", divergence.weight(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.c + 5) // (x.n + 5 * x.v) for x in out)
    assert spark.range(1).select(divergence.weight(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("p")).first().p is None
    buckets = spark.range(1, 5000).select("id", divergence.bucket(F.col("id")).alias("b")).collect()
    assert all(x.b <= x.id < x.b + max(1, x.b / 8) and (x.id >= 16 or x.b == x.id) for x in buckets)
