"""WARC archives: written by Spark, read back by byte ranges.

Writing: a record is one gzip member.  Spark's text writer puts members to files,
with an empty member between two where it would put a line end, so files are valid
archives and come with Spark's own commit: a task that runs again leaves one copy.

Reading: files are listed without their content and cut into byte ranges.  A task
looks in its range for the gzip magic, takes a place for a member only if it
decodes to a WARC header, and owns the records that start in its range, also where
they end beyond it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blastradius.llm.common import partitions, ship

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Payloads below this many bytes are always written in full.
LEAST_REVISIT = 100
RANGE_BYTES = 4 << 20
_CHUNK = 1 << 20
_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_first(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, first: of rows whose payloads are equal and long enough, the smallest id.

    One row per digest is made before rows meet, and rows join on the digest alone,
    so a digest of very many rows is an ordinary skewed join that Spark splits.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first")


def _line(value: str) -> bytes:
    """A header value: control characters would end it."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode()


def _member(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    revisit = first is not None and page != first
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if page is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page)
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    if revisit:
        head += [b"WARC-Refers-To: <urn:page:%d>" % first, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(rows: DataFrame, folder: str) -> None:
    """One archive a partition of ``with_first``'s rows, below ``folder``."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few whole records at a time
                part = batch.slice(at, 64)
                made = [_member(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


class _Reader:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        chunk = self.file.read(_CHUNK)
        self.data += chunk
        return bool(chunk)

    def drop(self, place: int) -> None:
        self.data, self.base = self.data[place - self.base :], place

    def find(self, place: int, end: int) -> int:
        """The next magic at ``place`` or after it, before ``end``; -1 if there is none."""
        while True:
            found = self.data.find(MAGIC, max(0, place - self.base))
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            place = max(place, self.base + len(self.data) - len(MAGIC) + 1)
            if place >= end or not self.more():
                return -1
            self.drop(max(self.base, min(place, self.base + len(self.data))))

    def member(self, place: int) -> tuple[bytes, int] | None:
        """(content, where it ends), or None if no member with a WARC header or nothing in it starts there."""
        self.drop(place)
        unpack, out, at = zlib.decompressobj(31), [], 0
        head = b""
        try:
            while not unpack.eof:
                if at == len(self.data) and not self.more():
                    return None  # cut off
                out.append(unpack.decompress(self.data[at:]))
                at = len(self.data)
                if len(head) < 7:
                    head = b"".join(out)[:7]
                    if head != b"WARC/1."[: len(head)]:
                        return None
        except zlib.error:
            return None
        return b"".join(out), self.base + at - len(unpack.unused_data)


def records(file, start: int, end: int) -> Iterator[bytes]:
    """Contents of the non-empty members that start from ``start`` to before ``end``."""
    reader = _Reader(file, start)
    place = reader.find(start, end)
    while place >= 0:
        got = reader.member(place)
        if got and got[0]:
            yield got[0]
        place = reader.find(got[1] if got else place + 1, end)


def _parsed(record: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes] | None:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    kind = fields.get(b"warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: int(m[1]) if (m := re.search(rb":(-?\d+)>$", fields.get(key, b""))) else None
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size, digest = int(re.search(rb"(?i)\nContent-Length: *(\d+)", http)[1]), fields[b"warc-payload-digest"].rpartition(b":")[2].decode()
    url = fields.get(b"warc-target-uri")
    return number(b"warc-record-id"), url and url.decode(), size, digest, kind, number(b"warc-refers-to"), payload


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Response and revisit records: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    Digest and length of a response are taken anew from its payload; those of a
    revisit are of the payload it refers to.  Other record types are passed over;
    a place that only looks like a member is no record.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        n = 7 if with_payload else 6
        for batch in batches:
            for path, _, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
                rows: list[tuple] = []
                with store.open_input_file(name) as file:
                    for record in records(file, start, start + range_bytes):
                        if parsed := _parsed(record):
                            rows.append(parsed[:n])
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:n], strict=True)], names[:n])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:n], strict=True)], names[:n])

    return ranges.repartition(partitions(spark), "path", "start").mapInArrow(run, _ROW + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` to archives below ``folder`` and read them back.

    Null html is an empty payload, a null url is left out, a null id gives a record
    without one and is never referred to.  Rows that repeat the smallest id of
    their payload are all responses.  An empty table writes no record.
    """
    write_archives(with_first(pages), folder)
    return read_archives(pages.sparkSession, folder)
