"""Legacy archive converter (operator 6): ARC version 1 and 2 to WARC 1.1, and readers of both.

Records are parsed by their version's header line and declared length, never by looking for separators in content.
Archives travel as rows of a written table, (archive, data), each a whole gzip member series: Spark's committer makes
them whole or absent whichever executor is lost, on any store that Spark writes. save_archives writes them out as
.warc.gz files, which any reader opens.

Payloads are held equal if their SHA-1 digests and lengths are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vekspar.llm.common import chunks, written

ARCHIVE_CHARS = 4_000_000
DATE = "20240101000000"
# The URL record definitions of the ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _uri(url: str | None) -> str:
    return quote(url or "", safe=":/?#[]@!$&()*+,;=%~") or "-"


def arc_file(name: str, version: int, records: Iterable[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, media type, network document)."""
    about = f"{version} 0 -\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain"
    out = io.BytesIO()
    out.write((f"{line} {len(about)}\n" if version == 1 else f"{line} 200 - - 0 {name} {len(about)}\n").encode() + about + b"\n")
    for url, date, kind, body in records:
        line = f"{_uri(url)} 0.0.0.0 {date} {kind}"
        out.write((f"{line} {len(body)}\n" if version == 1 else f"{line} 200 - - {out.tell()} {name} {len(body)}\n").encode())
        out.write(body + b"\n")
    return out.getvalue()


def arc_about(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields and body of the version block, and where it ends."""
    head, body, at = _arc_line(data, 0, None)
    if (version := body.split(b"\n")[0].split(b" ")[0]) not in (b"1", b"2"):
        raise ValueError(f"ARC version {version!r}")
    return head, body, at


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of each record after the version block, whose second line says what fields there are."""
    _, body, at = arc_about(data)
    names = body.split(b"\n")[1].decode().split(" ")
    while at < len(data):
        head, body, at = _arc_line(data, at, names)
        yield head, body


def _arc_line(data: bytes, at: int, names: list[str] | None) -> tuple[dict[str, str], bytes, int]:
    end = data.index(b"\n", at)
    values = data[at:end].decode().split(" ")
    names = names or FIELDS[1 if len(values) == 5 else 2].split(" ")
    if len(values) != len(names):
        raise ValueError(f"{len(values)} ARC fields where {len(names)} are declared")
    head = dict(zip(names, values, strict=True))
    size = int(head["Archive-length"])
    if size < 0 or end + 1 + size > len(data):
        raise ValueError("an ARC record is shorter than declared")
    after = end + 1 + size
    return head, data[end + 1 : after], after + (data[after : after + 1] == b"\n")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload."""
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if body.startswith(b"HTTP/") and end >= 0 else (b"", body)


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"\r\n" + name.encode() + rb": *([^\r\n]*)", head, re.I)
    return m[1].decode() if m else None


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{digest}')}>"


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def convert(arc: bytes, refers: dict[str, tuple[str, str, str]]) -> bytes:
    """The WARC of an ARC, a gzip member for each record. refers: a record's key to the key, URL and date of the record that it revisits.

    Key: the X-Page-Id field of the record's HTTP head, or its URL. The version block becomes a warcinfo record. Dates
    become ISO 8601, ids are UUIDs of key and digest (so they are the same wherever in an archive a record is, and a
    rerun gives the same), types are response, or revisit for records whose payload is elsewhere.
    """
    out = io.BytesIO()
    about, body, _ = arc_about(arc)
    name = about["URL"].removeprefix("filedesc://")
    info, block = record_id(about["URL"], payload_digest(body)), f"software: vekspar\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("WARC-Date", _iso(about["Archive-date"])), ("WARC-Filename", f"{name.removesuffix('.arc')}.warc.gz"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    out.write(_member(fields, block))
    for head, body in read_arc(arc):
        http, payload = split_http(body)
        key = http_field(http, "X-Page-Id") if http else None
        key, digest = head["URL"] if key is None else key, payload_digest(payload)
        of = refers.get(key)
        block = http if of is not None else body
        fields = [
            ("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Warcinfo-ID", info), ("WARC-Date", _iso(head["Archive-date"])), ("WARC-Target-URI", head["URL"]),
            ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ]
        if of is not None:
            to, url, date = of
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to, digest)), ("WARC-Refers-To-Target-URI", _uri(url)), ("WARC-Refers-To-Date", _iso(date)), ("X-Refers-To-Page", to)]
        out.write(_member(fields, block))
    return out.getvalue()


def read_warc(data: bytes, piece: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC with a gzip member for each record, its digest checked."""
    at, held = 0, b""
    while at < len(data) or held:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not held:
                if at >= len(data):
                    raise ValueError("a WARC record ends early")
                held, at = data[at : at + piece], at + piece
            parts.append(z.decompress(held))
            held = z.unused_data
        one = b"".join(parts)
        end = one.index(b"\r\n\r\n")
        lines = one[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = one[end + 4 : end + 4 + int(head["Content-Length"])]
        if head["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"bad block digest in {head['WARC-Record-ID']}")
        yield head, block


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, bytes, key, refers) of pages (page_id, url, html): refers is (key, url) of the page with an equal payload and the smallest page_id, null for that page itself.

    A null html is an empty payload. Of rows that share the smallest id and the payload that with the least url is the
    response, any one of equal rows; a null id comes after all others. Payloads below min_bytes are never revisits.
    key: the page_id, empty for a null one; further rows of a page_id and payload have their place in the input after a
    ~, as records need different ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            html = b.column("html").cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(html, pa.binary()), pa.array([payload_digest(x) for x in html]), pa.array([len(x) for x in html], pa.int64())], ["page_id", "url", "payload", "digest", "bytes"])

    kind = dict(pages.dtypes)["page_id"]
    p = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, payload binary, digest string, bytes long")
    p = p.withColumn("at", F.struct(F.col("page_id").isNull(), "page_id", "url", F.monotonically_increasing_id().alias("row")))
    # the least page of each digest, and how many rows its commonest page_id has
    by_page = p.groupBy("digest", "bytes", "page_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = by_page.groupBy("digest", "bytes").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1").drop("n")
    # payloads are shuffled by this join at most, whose hot digests can be split
    p = p.join(first, ["digest", "bytes"], "left")
    later = F.col("at") != F.col("first")
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    again = later & (F.col("most") > 1)
    p = p.withColumn("key", F.when(again, F.concat(key(F.col("page_id")), F.lit("~"), F.col("at.row").cast("string"))).otherwise(key(F.col("page_id"))))
    refers = F.when(later & (F.col("bytes") >= min_bytes), F.struct(key(F.col("first.page_id")).alias("key"), F.col("first.url").alias("url")))
    return p.select("page_id", "url", "payload", "digest", "bytes", "key", refers.alias("refers"))


def write_archives(records: DataFrame) -> DataFrame:
    """The written table (archive, data) of WARCs converted from ARC files of about ARCHIVE_CHARS characters, of either version in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "url", "payload", "refers", "digest")
        held, size, made = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(r[0] + r[4] for r in held))}"
            rows, refers = [], {}
            for key, url, payload, of, _ in held:
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(payload)}\r\n\r\n"
                rows.append((url or "", DATE, "text/html", http.encode() + payload))
                if of is not None:
                    refers[key] = (of["key"], of["url"], DATE)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([convert(arc_file(f"{name}.arc", 1 + made % 2, rows), refers)], pa.binary())], ["archive", "data"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= ARCHIVE_CHARS:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return written(records.mapInArrow(run, "archive string, data binary"), "warc")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as folder/<archive>.warc.gz, whole or not at all, from the executors; (archive, path, size) of each.

    folder: a path or URI that all executors reach, of any file system that pyarrow knows. A rerun writes the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for name, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist(), strict=True):
                path, new = f"{root}/{name}.warc.gz", f"{root}/_{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(new, compression=None) as out:
                    out.write(data)
                store.move(new, path)
                rows.append((name, path, len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["archive", "path", "size"])

    return archives.mapInArrow(run, "archive string, path string, size long")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each WARC record of a page: page_id, payload_bytes, payload_digest, record_type, refers_to (strings and longs as read) and its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri", "refers_to_id"]
        for b in batches:
            for data in b.column("data").to_pylist():
                rows = []
                for head, block in read_warc(data):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    size = int(http_field(http, "Content-Length"))
                    if head["WARC-Type"] == "response" and (size != len(payload) or head["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}"):
                        raise ValueError(f"bad payload in {head['WARC-Record-ID']}")
                    rows.append((http_field(http, "X-Page-Id").partition("~")[0] or None, size, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], head.get("X-Refers-To-Page") or None, head["WARC-Record-ID"], head["WARC-Date"], head["WARC-Target-URI"], head.get("WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "payload_bytes" else pa.string()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    return archives.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, warc_date string, target_uri string, refers_to_id string")
