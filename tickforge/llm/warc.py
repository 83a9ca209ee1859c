"""WARC files: records as text, and a reader of their bytes that gives each record's place and digest.

Files are plain, or gzip with a member a record. A record whose length doesn't lead to another one ends where the
next version line begins. Bytes that no record claims, as a file's damaged beginning, are a record without an id.
A file is held whole by the task that reads it, so it may have 2 GB at most; an empty one has no record.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, tune

NEXT = re.compile(rb"WARC/1\.\d\r\n")
RECORD_ID = re.compile(rb"^WARC-Record-ID:[ \t]*<([^>\r\n]*)>", re.I | re.M)
LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)", re.I | re.M)
CHUNK = 1 << 16


def response(record_id: Column, url: Column, body: Column, date: str) -> Column:
    """A response record with an HTML body; null fields count as empty, a null url as the record's id."""
    body = F.coalesce(body, F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <", record_id, f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: ", F.coalesce(url, record_id),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(http).cast("string"), "\r\n\r\n",
    )
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), http, F.lit("\r\n\r\n"))


def write(records: Column, rows: DataFrame, path: str) -> None:
    """Files of the records, which end with a line feed, one a task; null records are left out."""
    rows = rows.select(records.alias("r")).where("r IS NOT NULL")
    rows.select(F.expr("substring(r, 1, length(r) - 1)").alias("value")).write.text(path, lineSep="\n")


def plain_records(data: bytes) -> Iterator[tuple[int, int]]:
    """(begin, end) of each record of uncompressed bytes."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = LENGTH.search(data, at, head) if head >= 0 and NEXT.match(data, at) else None
        end = head + 4 + int(size[1]) + 4 if size else -1
        if not size or data[end - 4 : end] != b"\r\n\r\n" or end < len(data) and not NEXT.match(data, end):
            other = NEXT.search(data, at + 1)
            end = other.start() if other else len(data)
        yield at, end
        at = end


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, content) of each gzip member; what can't be unpacked is one member to the end, with its raw bytes."""
    at = 0
    while at < len(data):
        unpack, parts, end = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and end < len(data):
                parts.append(unpack.decompress(data[end : end + CHUNK]))
                end = min(end + CHUNK, len(data))
        except zlib.error:
            unpack = None
        if unpack is None or not unpack.eof:
            yield at, len(data), data[at:]
            return
        end -= len(unpack.unused_data)
        yield at, end, b"".join(parts)
        at = end


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each record in the file's bytes."""
    if data[:2] == b"\x1f\x8b":
        for a, b, content in members(data):
            yield a, b - a, content
    else:
        for a, b in plain_records(data):
            yield a, b - a, data[a:b]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, size, record_id, digest): place and length in the file, and the unpacked record's bytes
    and SHA-256; the id is null where a record has none."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for a, n, content in records(data.as_py()):
                    found = RECORD_ID.search(content, 0, max(content.find(b"\r\n\r\n"), 0))
                    rows.append((name, a, n, len(content), found[1].decode(errors="replace") if found else None, hashlib.sha256(content).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "offset", "length", "size", "record_id", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(run), "file string, offset long, length long, size long, record_id string, digest string")
