"""ZIP-packaged WARC archives: round trips, foreign and odd archives."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest

from fablens.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string"
SAME = "<p>é same</p>"
ROWS = [(7, "http://a/", SAME), (3, "http://b/é\r\nX: y", SAME), (9, None, SAME), (None, "http://c/", SAME), (1, "u", ""), (2, "u", None), (2, "u", None), (4, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "x" * 9000), (6, "u", "PK\5\6 PK\3\4"), (None, "u", "alone"), (None, None, "alone")]


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def wanted(rows=ROWS, least=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    out = []
    for i, _, html in rows:
        text = html or ""
        ids = [j for j, _, h in rows if (h or "") == text and j is not None]
        first = min(ids) if ids and len(text.encode()) >= least else None
        other = first is not None and (i is None or first < i)
        out.append((i, len(text.encode()), sha(text), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "other", "other") for r in rows], PAGES).repartition(2)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def opened(path):
    store, name = warc.filesystem(path)
    return store.open_input_file(name)


@pytest.mark.parametrize(("archive_bytes", "range_bytes", "wide", "least"), [(1 << 30, 1 << 22, False, 0), (1, 1, True, 0), (700, 700, False, 10)])
def test_round_trip(spark, tmp_path, monkeypatch, archive_bytes, range_bytes, wide, least):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    files = warc.write_archives(warc.with_revisits(pages(spark), least=least), f"file://{tmp_path}/a", archive_bytes, wide)
    assert sum(f.n_records for f in files.collect()) == len(ROWS) and (files.count() > 2) == (archive_bytes < 1 << 30)
    back = warc.read_archives(files)
    assert found(back) == wanted(least=least)
    texts = {r.page_id: r.payload for r in back.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert bytes(texts[4]).decode() == ROWS[7][2] and bytes(texts[3]).decode() == SAME
    for f in files.collect():  # other tools read them too
        with zipfile.ZipFile(f.path.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX] and all(i.compress_type == 0 for i in z.infolist())
            assert gzip.decompress(z.read(warc.DATA)).count(b"WARC-Type: ") == f.n_records


def test_empty_table_and_lost_payload(spark, tmp_path):
    none = pages(spark).filter("false")
    files = warc.write_archives(warc.with_revisits(none), f"file://{tmp_path}/none")
    assert files.count() == 0 and warc.read_archives(files).count() == 0
    raw = warc.record(1, "u", b"text").replace(b"text", b"tent")
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(raw)


def archive(members, comment=b"", before=b"", deflated=False, wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            with z.open(name, "w", force_zip64=wide) as m:
                m.write(data)
        z.comment = comment
    return before + out.getvalue()


def listed(spark, tmp_path, data):
    (tmp_path / "x.zip").write_bytes(data)
    df = spark.createDataFrame([(f"file://{tmp_path}/x.zip",)], "path string")
    return found(warc.read_archives(df))


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, packed):
    """No index; a comment that holds an end record; bytes before the archive; indexes of several record members."""
    records = [warc.record(1, "u", b"one" * 50_000), warc.record(2, "u", b""), warc.record(3, "u", b"one" * 50_000, 1)]
    want = [(1, 150_000, sha("one" * 50_000), "response", None), (2, 0, sha(""), "response", None), (3, 150_000, sha("one" * 50_000), "revisit", 1)]
    parts = [gzip.compress(r) if packed else r for r in records]
    name = "archive/x.warc.gz" if packed else "archive/x.warc"
    fake = b"PK\5\6" + b"\0" * 10 + b"PK\5\6"
    for data in (archive({name: b"".join(parts)}), archive({"page.txt": b"?", name: b"".join(parts)}, fake, b"#!/bin/sh\n" * 9, wide=True)):
        assert listed(spark, tmp_path, data) == want
    two = {"archive/a.warc.gz": parts[0], "archive/b.warc": parts[1] + parts[2]}
    lines = [("a.warc.gz", 0, len(parts[0])), ("b.warc", 0, len(parts[1])), ("b.warc", len(parts[1]), len(parts[2]))]
    two["indexes/index.cdxj"] = "".join(f"k 2020 {json.dumps({'filename': n, 'offset': str(o), 'length': str(m)})}\n" for n, o, m in lines).encode().rstrip()
    assert listed(spark, tmp_path, archive(two)) == want
    with pytest.raises(ValueError, match="stored"), open(tmp_path / "y.zip", "wb+") as f:
        f.write(archive({name: b"".join(parts)}, deflated=True))
        list(warc.located(f, f.tell()))


def test_zip64_directories(tmp_path):
    """All of a ZIP64 directory's fields, as an archive beyond 4 GiB has them: the plain ones are all ones."""
    import struct

    body = warc.record(1, "u", b"far")
    n = len(body)
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 6, 20) + b"x.warc" + struct.pack("<HHQQ", 1, 16, n, n)
    for before in (b"", b"stub"):
        extra = struct.pack("<HHB", 9, 1, 0) + struct.pack("<HHQQQ", 1, 24, n, n, 0)
        entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 6, len(extra), 3, 0, 0, 0, 0xFFFFFFFF) + b"x.warc" + extra + b"com"
        at = len(local) + n
        end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
        data = before + local + body + entry + end64 + b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        f = io.BytesIO(data)
        (place, length), = warc.located(f, len(data))
        assert warc.parsed(data[place : place + length])[:2] == (1, 3)
    with pytest.raises(ValueError, match="no end"):
        warc.directory(io.BytesIO(b"x" * 100), 100)
