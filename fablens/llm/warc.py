"""WARC records in ZIP archives: written a file a task, read back by ranges.

An archive is a ZIP file of stored (not deflated) members: ``archive/data.warc.gz``, WARC records of one gzip member each, and
``indexes/index.cdxj``, a line for each record with its place. ``directory`` reads a ZIP file's own directories: the end record
behind any comment, the ZIP64 end record and its locator, ZIP64 sizes and offsets of entries, bytes put before the archive.
A stored member is then a range of the file, and so is each record in it: nothing is extracted, and a reader fetches
neighbouring records by one read of at most ``RANGE_BYTES`` (or one longer record). Archives without an index are walked
record by record. Deflated or encrypted record members are an error that names the file.

Records of equal payloads: the smallest id is written as a response, the others as revisits that name it and keep the HTTP
header with the payload's length. Payloads are compared by 256-bit digests; only digests and ids are shuffled to find the
smallest, with partial minima, so a payload that a third of all rows share is no hot key there; Spark broadcasts the repeated
ones where they are few, and splits skewed parts of the join otherwise.

Files are reached through ``pyarrow.fs`` by their URI (file, hdfs, s3, gs), from every executor. A task's file has a name of
its own, and only files that a finished task reported are read, so a lost or repeated task does no harm.

Defined cases: a null payload is empty; a null id is no smallest one: such a row revisits the smallest id if there is one, and
is a response if not; rows that repeat an id with its payload are alike, all responses if the id is the smallest; payloads
shorter than ``least`` bytes are all responses; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, checkpointed, delete_folder, ship, table

#: A file is closed when it holds so much; neighbouring records are read together up to RANGE_BYTES.
ARCHIVE_BYTES, RANGE_BYTES, LEVEL = 512 << 20, 4 << 20, 5
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


# records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response, or with ``refers_to`` a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else f"<{URN}{refers_to}>"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    own = urn.strip("<>").removeprefix(URN)
    return int(own) if own else None


def parsed(raw: bytes) -> tuple:
    """A row of ``RECORD`` from one record; a response's payload must have the digest that its header names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    named = _fields(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if named["warc-type"] == "revisit":
        return _page(named["warc-record-id"]), int(_fields(http)["content-length"]), digest, "revisit", _page(named["warc-refers-to"]), None
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {named['warc-record-id']} does not have its digest")
    return _page(named["warc-record-id"]), len(payload), digest, named["warc-type"], None, payload


# ZIP directories


def directory(file, size: int) -> list[dict]:
    """name, method, flags, size (stored bytes), header (place of the local header) of each member."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65557)
    tail, end = read(tail_at, size - tail_at), size
    while True:  # the end record, of which a comment may hold a fake
        at = tail.rfind(b"PK\5\6", 0, end)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        if len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
            break
        end = at + 3
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    ends_at = tail_at + at
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(ends_at - 20, 20) if ends_at >= 20 else b""
        if locator[:4] == b"PK\6\7":
            # bytes before the archive move the record that the locator names; it then stands right before the locator
            for place in (struct.unpack_from("<Q", locator, 8)[0], ends_at - 76):
                whole = read(place, 56)
                if whole[:4] == b"PK\6\6":
                    count, length, start = struct.unpack_from("<QQQ", whole, 32)
                    ends_at = place
                    break
            else:
                raise ValueError("no ZIP64 end record where its locator says")
    shift = ends_at - length - start
    entries, at, out = read(start + shift, length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken entry in a ZIP directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # ZIP64: those of full size, stored size and header that don't fit above, in this order
                wide = list(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, x + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            x += 4 + n
        out.append({"name": name, "method": method, "flags": flags, "size": stored, "header": header + shift})
        at += 46 + n_name + n_extra + n_comment
    return out


def stored_at(file, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"] or member["flags"] & 1:
        raise ValueError(f"{member['name']} is deflated or encrypted; only stored members can be read by ranges")
    file.seek(member["header"])
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def located(file, size: int) -> Iterator[tuple[int, int]]:
    """Place in the file and length of every WARC record of an archive: by its indexes, else by walking its record members."""
    members = directory(file, size)
    data = {m["name"].rsplit("/", 1)[-1]: m for m in members if re.search(r"\.warc(\.gz)?$", m["name"])}
    indexes = [m for m in members if m["name"].startswith("indexes/") and re.search(r"\.cdxj?$", m["name"])]
    at = {name: stored_at(file, m) for name, m in data.items()}
    for m in indexes:
        file.seek(stored_at(file, m))
        rest, left = b"", m["size"]
        while left:
            got = file.read(min(left, RANGE_BYTES))
            left -= len(got)
            *lines, rest = (rest + got).split(b"\n")
            for line in [*lines, rest] if not left else lines:
                if line.strip():
                    entry = json.loads(line[line.index(b"{") :])
                    yield at[entry["filename"]] + int(entry["offset"]), int(entry["length"])
    if not indexes:
        for name, m in data.items():
            yield from _walked(file, at[name], at[name] + m["size"])


def _walked(file, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Records of a member without an index."""
    while at < end:
        file.seek(at)
        head = file.read(min(1 << 16, end - at))
        if head[:2] == b"\x1f\x8b":  # a gzip member's end shows only by unpacking it
            unpack, used = zlib.decompressobj(31), 0
            while not unpack.eof:
                if not head:
                    raise ValueError("a gzip member ends early")
                while head and not unpack.eof:
                    unpack.decompress(head, 1 << 20)
                    used += len(head) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
                    head = unpack.unconsumed_tail
                if not unpack.eof:
                    file.seek(at + used)
                    head = file.read(min(1 << 16, end - at - used))
            n = used
        else:
            stop = head.index(b"\r\n\r\n")
            n = stop + 4 + int(_fields(head[:stop])["content-length"]) + 4
        yield at, n
        at += n


# Spark


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: null for a response."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    own = rows.withColumn("digest", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    first = own.select("page_id", "digest").dropna().groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    alone = own.filter("page_id IS NULL").select("digest").distinct().withColumn("odd", F.lit(True))  # ids are rarely null
    repeated = first.join(alone, "digest", "left").filter("n > 1 OR odd").select("digest", "first")
    joined = own.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, wide: bool = False) -> DataFrame:
    """Write rows of ``with_revisits`` to ZIP files in ``folder``; path and records of each. ``wide`` writes ZIP64 throughout.

    The result is the list of files that count. It is checkpointed, so files aren't written again with each use of it.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        rows = ((i, url, payload, first) for b in batches for i, url, payload, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True))
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.zip", io.BytesIO(), 0
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as data:
                    n = 0
                    while row is not None and (at < archive_bytes or not n):
                        i, url, payload, first = row
                        packed = gzip.compress(record(i, url, payload.as_py(), first), LEVEL, mtime=0)
                        data.write(packed)
                        index.write(f"{URN}{'' if i is None else i} {json.dumps({'filename': 'data.warc.gz', 'offset': at, 'length': len(packed)})}\n".encode())
                        at, n, row = at + len(packed), n + 1, next(rows, None)
                with archive.open(INDEX, "w", force_zip64=wide) as member:
                    member.write(index.getbuffer())
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    return checkpointed(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long"))


def read_archives(files: DataFrame, path: str = "path", payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) of the ZIP files that ``files`` names. Directories and indexes are read first, a file a row;
    the ranges they give are dealt out anew, so one large file is read by many tasks."""
    ship(files.sparkSession)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, name = filesystem(uri)
                starts, lengths = [], []
                with store.open_input_file(name) as file:
                    for at, n in located(file, file.size()):
                        if lengths and (at != starts[-1] + sum(lengths) or sum(lengths) + n > RANGE_BYTES):
                            yield pa.RecordBatch.from_pydict({"path": [uri], "at": starts, "lengths": [lengths]})
                            starts, lengths = [], []
                        starts = starts or [at]
                        lengths.append(n)
                if lengths:
                    yield pa.RecordBatch.from_pydict({"path": [uri], "at": starts, "lengths": [lengths]})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = filesystem(uri)
                with store.open_input_file(name) as file:
                    file.seek(at)
                    raw = memoryview(file.read(sum(lengths)))
                rows = []
                for n in lengths:
                    one = bytes(raw[:n])
                    raw = raw[n:]
                    row = parsed(gzip.decompress(one) if one[:2] == b"\x1f\x8b" else one)
                    rows.append(row if payloads else (*row[:-1], None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    found = files.select(F.col(path).alias("path")).mapInArrow(ranges, "path string, at long, lengths array<long>")
    return found.repartition("path", "at").mapInArrow(fetch, RECORD)


def op13(spark, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    back = checkpointed(read_archives(files, payloads=False).drop("payload"))
    delete_folder(spark, folder)
    return back


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> {s}) % 32 AS BIGINT), 1)" for s in (15, 10, 5, 0))
OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT)) AS parts FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(parts, lambda v: {_BASE32}), '') AS payload_digest,
 CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
FROM g
"""
