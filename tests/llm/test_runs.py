"""Periodic runs against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fablens.llm import registry, runs

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, runs string"


def plain_runs(w):
    """(start, length, period): every stretch of period q that goes no further, q being its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, m = i, j - i + q
            if m >= max(6, 4 * q) and not any(w[s : s + m - z] == w[s + z : s + m] for z in range(1, q)):
                out.append((s, m, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_words(r):
    k, n = r.randint(1, 4), r.choice([0, 1, 5, 6, 20, 60, 150])
    w = [chr(97 + r.randrange(k)) for _ in range(n)]
    if r.random() < 0.7 and n:
        p = r.randint(1, 12)
        b = [chr(97 + r.randrange(3)) for _ in range(p)]
        a = r.randrange(n)
        w = w[:a] + b * r.randint(3, 9) + b[: r.randrange(p)] + w[a:]
        if r.random() < 0.4:
            w = w * r.randint(2, 5)
    return w


def test_refinement_equals_plain_runs():
    r = random.Random(1)
    for _ in range(300):
        texts = [some_words(r) for _ in range(r.randint(1, 6))]
        words, at = runs.numbered([[x.encode() for x in w] for w in texts])
        start, length, period = runs.find_runs(words, at)
        of = np.searchsorted(at, start, "right") - 1
        got = [[(int(s - at[i]), int(m), int(q)) for s, m, q, o in zip(start, length, period, of, strict=True) if o == i] for i in range(len(texts))]
        assert got == [plain_runs(w) for w in texts]


def test_registered_query_equals_plain_rows(spark):
    got = registry.QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(d.doc_id, d.text, True) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(got) == sorted(want, key=str) and sum(w[1] for w in want) > 5


@pytest.mark.parametrize("batch", [1, 300, 1 << 20])
def test_defined_cases(spark, monkeypatch, batch):
    """Nulls, empty texts, ties, repeated rows, other spaces, a long text, a clashing name; in batches of any size."""
    monkeypatch.setattr(runs, "BATCH_BYTES", batch)
    texts = [None, "", "  \t", "a a a a a a", "a a a a a", "x a b a b a b a b c c c c c c c c", "a a a a a a A a", "é é é é é é é ü", "u v w " * 400 + "u v z", " ".join(f"w{i}" for i in range(3000)) + " q" * 3000]
    data = [(i, t, "other") for i, t in enumerate(texts)] + [(3, texts[3], "other"), (None, texts[5], "other"), (None, None, "other")]
    df = spark.createDataFrame(data, TEXT).repartition(2)
    got = runs.run_digests(runs.word_runs(df))
    assert rows(got) == sorted((plain_row(i, t, False) for i, t, _ in data), key=str)
    both = runs.word_runs(df.filter("doc_id = 5")).first()
    assert (both.runs[0].start, both.runs[0].length, both.runs[0].period, both.collapsed) == (1, 8, 2, "x a b c")
    assert [(r.start, r.length, r.period) for r in both.runs] == [(1, 8, 2), (9, 8, 1)]
    assert runs.run_digests(runs.word_runs(df.filter("false"))).count() == 0
