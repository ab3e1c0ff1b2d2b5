"""Registered queries against the tokenizers library, row by row; a plain language model; defined cases of older operators."""

import hashlib
import math
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from fablens.llm import chat, dac, encode, langid, licenses, registry

SF = "/root/testdata/sf0.001"


def test_registered_encodings_equal_the_library(spark):
    library = Tokenizer.from_file(encode.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    eight, ten, start = [], [], 0
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        eight.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        ten.append((doc_id, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, registry.QUERIES["op8_bpe_encode"](spark, SF).collect())) == eight
    got = registry.QUERIES["op10_token_binary"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == ten


# defined cases of older operators


def plain_mixture(counts, probs, rounds=12):
    """Expectation-maximisation over single trigrams: {bucket: n} and one {bucket: p} a language."""
    share, total, before = [1 / len(probs)] * len(probs), sum(counts.values()), -math.inf
    value = lambda: sum(n * math.log(sum(s * p[b] for s, p in zip(share, probs, strict=True))) for b, n in counts.items())
    for _ in range(rounds):
        now = value()
        if now - before < 1e-3:
            break
        before = now
        taken = [0.0] * len(probs)
        for b, n in counts.items():
            parts = [s * p[b] for s, p in zip(share, probs, strict=True)]
            for i, x in enumerate(parts):
                taken[i] += n * x / sum(parts)
        share = [t / total for t in taken]
    return share, value()


def plain_language(text, langs, probs):
    found = langid.trigrams(text)
    if found is None:
        return "und", 0.0, set()
    counts = {int(b): int(found[b]) for b in np.flatnonzero(found)}
    tables = [{b: float(probs[b, i]) for b in counts} for i in range(len(langs))]
    single = [sum(n * math.log(t[b]) for b, n in counts.items()) for t in tables]
    best = single.index(max(single))
    chosen, value = [best], single[best]
    share, full = plain_mixture(counts, tables)
    cost = 2 * math.log(sum(counts.values()) + 1)
    if full - value > cost:
        order = sorted(range(len(langs)), key=lambda i: -share[i])
        for m in range(2, len(langs) + 1):
            part, likelihood = plain_mixture(counts, [tables[i] for i in order[:m]])
            if likelihood - cost * (m - 1) > value:
                chosen, value, best = order[:m], likelihood - cost * (m - 1), order[part.index(max(part))]
    return langs[best], share[best], {langs[i] for i in chosen}


def test_languages_equal_a_plain_mixture(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, probs = langid.learn(train, "text", "lang", "doc_id")
    r = random.Random(4)
    texts = [t for (t,) in train.select("text").limit(60).collect()]
    texts = [" ".join((r.choice(texts) or "").split()[: r.randint(1, 60)] + (r.choice(texts) or "").split()[: r.randint(0, 60)]) for _ in range(60)] + ["", "12", None, "a" * 50_000, "der the le el"]
    df = spark.createDataFrame([(i, t, "?", "?") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string, languages string")
    got = {x.doc_id: x for x in langid.identify(df, langs, probs).collect()}
    for i, t in enumerate(texts):
        lang, score, chosen = plain_language(t or "", langs, probs)
        for x in (got[i], got[i + len(texts)]):  # repeated texts fare alike
            assert x.lang_pred == lang and abs(x.score - score) < 1e-6 and (lang == "und" or set(x.languages) == chosen)


def test_language_ties_go_to_the_first_by_name(spark):
    same = [(i, "one two three four", lang) for i, lang in enumerate(["b", "a", "c"] * 4)]
    df = spark.createDataFrame(same, "doc_id long, text string, lang string")
    langs, probs = langid.learn(df, "text", "lang", "doc_id")
    assert langs == ["a", "b", "c"] and {x.lang_pred for x in langid.identify(df, langs, probs).collect()} == {"a"}


def test_token_files_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, a very long text, columns with clashing names."""
    long = "word and " * 60_000
    rows = [(None, "x", "?", 1), (None, None, "?", 1), (5, "b", "?", 1), (5, "a", "?", 1), (5, "a", "?", 1), (2, long, "?", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, block long").repartition(3)
    dac.write_tokens(df, str(tmp_path / "t"), block_tokens=1000)
    got = sorted(dac.read_tokens(spark.read.parquet(str(tmp_path / "t"))).collect(), key=lambda x: x.start)
    library = Tokenizer.from_file(encode.tokenizer_path())
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in (None, "x", long, "a", "a", "b")]
    assert [x.doc_id for x in got] == [None, None, 2, 5, 5, 5] and [x.n_tokens for x in got] == list(map(len, want))
    assert [x.ids_crc32 for x in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_long_texts_and_clashing_names(spark):
    long = "été naïve 123 " * 30_000
    df = spark.createDataFrame([(1, long, 1, "?"), (2, "mit license", 2, "?")], "doc_id long, text string, ids int, labels string")
    x = encode.encode_documents(df).filter("doc_id = 1").first()
    assert x.decoded == long and list(x.ids) == Tokenizer.from_file(encode.tokenizer_path()).encode(long, add_special_tokens=False).ids
    assert [(g.doc_id, g.n_base) for g in licenses.license_scan(df).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def test_conversations_without_an_id_are_read_back(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, 0, "user", None), (3, 0, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {None, 3} and (got[None].n_turns, got[None].loss_chars) == (3, 1)
    assert got[None].turns_sha256 == hashlib.sha256(b"user\n\nuser\na\nassistant\nb\n").hexdigest()
