"""Stored ARC files (plain or of gzip members, versions 1 and 2) converted to WARC files.

Files are read by Spark, one at a time in a task, and parsed by their declared lengths.  A record is told by its file and its place in it.  One pass
gives the digest of every payload; of records with equal payloads the first by date, then by file and place, is the response and the others revisit it.  A second
pass converts each file with the list of its own revisits.  WARC files are written by Spark's text writer from raw bytes, so payloads need not be text.

Cases: a date of fewer than 14 digits is filled up with the first month, day and midnight; one that has no year is an error, as are a header line that its
version does not have and a record shorter than declared; records with empty payloads are all responses; an ARC file without records gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches
from .warc import END, FILE_LINES, LINE_BYTES, ArcRecord, arc_records, base32, split_http, to_warc

#: Most revisits that are broadcast (some 200 bytes each); more are joined by a shuffle of the files.
SENT_ROWS = 200_000


def unpacked(data: bytes) -> bytes:
    """A file's bytes; gzip members, one for each record or several, are unpacked one after another."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member without end")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def full_date(date: str) -> str:
    """Fourteen digits: what is missing is January, the first, midnight."""
    if not re.fullmatch(r"[0-9]{4,14}", date):
        raise ValueError(f"{date!r} is no date of an archive")
    return date + "00000101000000"[len(date) :]


def _records(data: bytes) -> Iterator[tuple[int, ArcRecord]]:
    """The records of a file and their numbers, with whole dates."""
    for k, r in enumerate(arc_records(unpacked(data))):
        yield k, ArcRecord(r.fields | {"date": full_date(r.fields["date"])}, r.block)


def _key(path: str, k: int) -> str:
    return f"{path}#{k}"


def _digests(batches):
    names = ["path", "k", "date", "sha"]
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = [(path, k, r.fields["date"], base32(payload)) for k, r in _records(data.as_py()) if (payload := split_http(r.block)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=names)


def _converted(batches):
    for b in batches:
        for path, data, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            of, line, size = {x["k"]: x["first"] for x in again or ()}, [], 0
            for k, record in _records(data.as_py()):
                line.append(to_warc(record, _key(path, k), of.get(k)))
                size += len(line[-1])
                if size >= LINE_BYTES:
                    yield _line(line)
                    line, size = [], 0
            if line:
                yield _line(line)


def _line(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([END.encode().join(records)], pa.binary())], names=["value"])


def revisits(files: DataFrame) -> DataFrame:
    """(path, k, first): the records whose payload another one has kept, and that one's key."""
    found = files.mapInArrow(_digests, "path string, k bigint, date string, sha string")
    order = F.struct("date", "path", "k")
    first = found.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = found.join(first, "sha").where(order != F.col("first"))
    return again.select("path", "k", F.concat_ws("#", "first.path", F.col("first.k").cast("string")).alias("first"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert all ARC files under a path into WARC files under another."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(arc_path).select("path", "content")
    again = cut(revisits(files))
    own = again.groupBy("path").agg(F.collect_list(F.struct("k", "first")).alias("again"))  # a file's own records
    own = F.broadcast(own) if again.count() <= SENT_ROWS else own
    lines = files.join(own, "path", "left").select("path", "content", "again").mapInArrow(_converted, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_LINES).text(warc_path)
