"""Legacy archive converter: ARC records become WARC records.

An ARC file starts with a ``filedesc:`` record that names its version; each record is a header line
(version 1: URL, IP, date, type, length; version 2: URL, IP, date, type, result code, checksum, location,
offset, file name, length) followed by as many bytes as the line declares, and a line feed.  A
converted record gets an identifier, an ISO timestamp, a type (response, or revisit where an equal payload is
kept elsewhere) and SHA-1 digests of block and payload.

Archives are written by Spark's text writer, whose line separator is the end of a WARC record; so
they go to any store that Spark can write, task by task, with its commit protocol.  What is written as a line is a
few megabytes of records, and a file has a few lines, so files roll by bytes and any of them can be held whole.  They
are read back by the declared lengths, never by searching for a separator.

Cases: a null payload counts as empty, a null URL as empty; empty payloads are equal to each other;
of equal payloads the smallest id is the response; white space in a URL or a type is percent-encoded in the header
line and decoded again; repeated ids give as many records, of which a row that repeats a response is a response;
rows with a null id are written as responses and never referred to; ids may be numbers or text; a very long payload
ends its line, which it may share with up to ``LINE_BYTES`` of records before it, and a file has ``FILE_LINES`` lines, held whole; an empty
table gives an archive without records.  Other columns of the pages are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_at_a_time, shared_path, small_batches

END = "\r\n\r\n"
CRLF = b"\r\n"
#: Bytes of records that are written as a line, at least, and lines in a file; files are read back whole.
LINE_BYTES, FILE_LINES = 4 << 20, 4
#: Most revisits that are broadcast (some 100 bytes each); more are joined by a shuffle of the pages.
SENT_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    block: bytes


def _token(s: str) -> str:
    """A field of a header line: no white space, never empty."""
    return re.sub(r"[\s%]", lambda m: quote(m.group(), safe=""), s) or "-"


def _plain(s: str) -> str:
    return "" if s == "-" else unquote(s)


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int = 2, date: str = "20240101000000") -> bytes:
    """An ARC file of (url, ip, date, type, block)."""
    about = f"{version} 0 edgeprobe\n{' '.join(('URL', 'IP-address', 'Archive-date', 'Content-type', *(('Result-code', 'Checksum', 'Location', 'Offset', 'Filename') if version == 2 else ()), 'Archive-length'))}\n".encode()
    out = [b""]
    size = 0
    for k, (url, ip, when, kind, block) in enumerate([("filedesc://edgeprobe.arc", "0.0.0.0", date, "text/plain", about), *records]):
        middle = "" if version == 1 else f" 200 - - {size} edgeprobe.arc"
        line = f"{_token(url)} {_token(ip)} {when} {_token(kind)}{middle} {len(block)}\n".encode()
        out.append(line + block + b"\n")
        size += len(out[-1])
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its ``filedesc:`` record not among them."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = version is None
        if first and not parts[0].startswith("filedesc:"):
            raise ValueError("no filedesc: record")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError("a record is shorter than declared")
        at = end + 1 + length
        if first:
            version = int(block.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        names = _FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields in a header line of version {version}")
        yield ArcRecord(dict(zip(names, parts, strict=True)), block)


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(key: str) -> str:
    """A record's identifier: the same for the same key."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP message; a block that is none is all payload."""
    if block.startswith(b"HTTP/"):
        head, found, payload = block.partition(b"\r\n\r\n")
        if found:
            return head + found, payload
    return b"", block


def to_warc(record: ArcRecord, key: str, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the four bytes that end it.  ``refers_to``: the key of an equal payload."""
    head, payload = split_http(record.block)
    d = record.fields["date"].ljust(14, "0")
    kind = "response" if refers_to is None else "revisit"
    block = record.block if refers_to is None else head
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": identifier(key),
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": re.sub(r"[\r\n]", lambda m: quote(m.group()), _plain(record.fields["url"])),
        "WARC-IP-Address": record.fields["ip"],
        "WARC-Payload-Digest": f"sha1:{base32(payload)}",
        "WARC-Block-Digest": f"sha1:{base32(block)}",
        "Content-Type": "application/http;msgtype=response" if head else _plain(record.fields["type"]),
        **(extra or {}),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": identifier(refers_to), "WARC-Profile": PROFILE}
    fields["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + CRLF + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(fields with lower-case names, block) of each record of a WARC file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        fields = {}
        for line in data[at:end].split(CRLF)[1:]:
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield fields, view[end + 4 : at]
        at += 4


def _key(page_id) -> str:
    return f"page:{page_id}"


def _convert(batches):
    """Pages through an ARC file of each few of them (of either version in turn) to the text of WARC records, many in a line."""
    line, size = [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([END.join(line)], pa.string())], names=["value"])

    for k, part in enumerate(few_at_a_time(batches, 2)):
        ids, urls, pages, first = (part.column(i).to_pylist() for i in range(4))
        raw = []
        for url, page in zip(urls, pages, strict=True):
            body = page.encode("utf-8", "surrogatepass")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            raw.append((url, "0.0.0.0", "20240101000000", "text/html", head + body))
        arc = arc_file(raw, version=1 + k % 2)
        del raw
        for i, f, record in zip(ids, first, arc_records(arc), strict=True):
            extra = {"X-Page-ID": "" if i is None else quote(i, safe="")}
            if f is not None:
                extra["X-Refers-To-Page"] = quote(f, safe="")
            out = to_warc(record, _key(i) if i is not None else f"page:none:{base32(record.block)}", None if f is None else _key(f), extra)
            line.append(out.decode("utf-8", "surrogatepass"))
            size += len(out)
            if size >= LINE_BYTES:
                yield row()
                line, size = [], 0
    if line:
        yield row()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each page.

    One shuffle of digests, counted map-side, finds the equal payloads.  The digests that more than 1/SENT_ROWS of
    all pages have are at most SENT_ROWS and are broadcast to the pages' ids; the others, none of which has many
    pages, are joined by a shuffle of ids.  The pages themselves are shuffled only if too many are revisits.
    """
    small_batches(pages.sparkSession)
    full = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = full.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha")).where("page_id is not null")
    files = pages.sparkSession.sparkContext.defaultParallelism  # of narrow rows: no more than there are cores to write them
    first = own.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
    first = cut(first.where("first < last").select("sha", "first", "n").coalesce(files))
    often = F.col("n") > (first.agg(F.sum("n")).first()[0] or 0) / SENT_ROWS
    found = own.join(F.broadcast(first.where(often).drop("n")), "sha").union(own.join(first.where(~often).drop("n"), "sha"))
    again = cut(found.where("page_id != first").select("page_id", "sha", "first").distinct().coalesce(files))
    if again.count() <= SENT_ROWS:
        again = F.broadcast(again)
    records = full.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(again, ["page_id", "sha"], "left")
    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "first")]
    records.select(*text).mapInArrow(_convert, "value string").write.option("lineSep", END).option("maxRecordsPerFile", FILE_LINES).text(path)


def _parse(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        for data in b.column(0):
            rows = []
            for fields, block in warc_records(data.as_py()):
                head, payload = split_http(bytes(block))
                stated = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", head)
                size = int(stated[1]) if stated else len(payload)
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (said != base32(payload) or size != len(payload)):
                    raise ValueError(f"damaged payload in {fields['warc-record-id']}")
                to = fields.get("x-refers-to-page")
                rows.append((unquote(fields["x-page-id"]) if fields["x-page-id"] else None, size, said, fields["warc-type"], None if to is None else unquote(to)))
                if len(rows) == 1000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def read_archives(spark, path: str, kind: str = "bigint") -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to; ids of type ``kind``."""
    files = small_batches(spark).read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(_parse, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
