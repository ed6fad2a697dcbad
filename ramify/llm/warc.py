"""WARC records in ZIP archives: written per task, read back by byte ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.cdxj``, one line per record with its
offset and length.  The reader finds the end record and, where sizes or counts need it, the
ZIP64 end record, walks the central directory, skips each member's local header, and then
slices single records out of the stored member; nothing is extracted.

Archives are rows (name, content) of bounded size; ``spark.read.format("binaryFile")`` rows serve
as well, with ``path`` as the name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes after which a task begins another archive, and the least payload that is deduplicated.
ARCHIVE_BYTES, REVISIT_BYTES = 8 << 20, 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_FULL = 0xFFFFFFFF


# --- ZIP -----------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ZIP64 records where sizes need them, or always."""
    out, central = [], []
    at = 0
    for name, data in members:
        label, crc = name.encode(), zlib.crc32(data)
        large = zip64 or len(data) >= _FULL or at >= _FULL
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = _FULL if large else len(data)
        out += [struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(extra)), label, extra, data]
        far = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if large else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(far), 0, 0, 0, 0, _FULL if large else at) + label + far)
        at += 30 + len(label) + len(extra) + len(data)
    directory = b"".join(central)
    large = zip64 or at >= _FULL or len(members) >= 0xFFFF
    end = b""
    if large:
        end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
        end += struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    count, where = (0xFFFF, _FULL) if large else (len(members), at)
    end += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, len(directory) if not large else _FULL, where, 0)
    return b"".join([*out, directory, end])


class ZipView:
    """Members of a ZIP file in memory, by byte ranges."""

    def __init__(self, content: memoryview):
        self.content = content
        self.members = {name: span for name, *span in self._directory()}

    def _end(self) -> tuple[int, int]:
        """(number of members, place of the central directory)."""
        tail = bytes(self.content[-(22 + 65535) :])
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        count, _, where = struct.unpack_from("<HII", tail, at + 10)
        begin = len(self.content) - len(tail) + at
        if (count == 0xFFFF or where == _FULL) and begin >= 20:
            sign, _, far, _ = struct.unpack_from("<IIQI", self.content, begin - 20)
            if sign == 0x07064B50:
                count, _, where = struct.unpack_from("<QQQ", self.content, far + 32)
        return count, where

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        count, at = self._end()
        for _ in range(count):
            head = struct.unpack_from("<IHHHHHHIIIHHHHHII", self.content, at)
            if head[0] != 0x02014B50:
                raise ValueError("broken ZIP central directory")
            method, packed, size, label, extra, note, where = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
            name = bytes(self.content[at + 46 : at + 46 + label]).decode()
            more, end = at + 46 + label, at + 46 + label + extra
            while more + 4 <= end:
                kind, length = struct.unpack_from("<HH", self.content, more)
                if kind == 1:  # fields that are full in the header, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", self.content, more + 4))
                    size = next(values) if size == _FULL else size
                    packed = next(values) if packed == _FULL else packed
                    where = next(values) if where == _FULL else where
                more += 4 + length
            yield name, method, where, packed
            at = end + note

    def member(self, name: str) -> memoryview:
        """The bytes of a stored member, not copied."""
        method, where, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        label, extra = struct.unpack_from("<HH", self.content, where + 26)
        begin = where + 30 + label + extra
        return self.content[begin : begin + size]


# --- WARC ----------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return "".join(c if c >= " " else " " for c in value)


def record(name: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record, gzipped; a revisit keeps the HTTP header and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Date: {_DATE}"]
    block = http if refers_to is not None else http + payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> dict[str, object]:
    """Headers of one record, and its payload or, for a revisit, none."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} does not hold the payload it names")
    return headers | {"kind": kind, "bytes": length, "digest": digest, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(name, content): archives with one record per row.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, one with the largest key is the
    response and the others revisit it.  A null payload is empty, a null url blank, and a null
    key sorts below all others.  Rows that repeat are records of their own.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= REVISIT_BYTES
    # one winner per digest: the counts are combined inside tasks, so a payload that a third of all rows share is no hot key
    first = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "response")
    joined = rows.join(first, "digest", "left")
    joined = joined.select("page_id", "url", "payload", F.when(long, F.col("response")).alias("response"), F.monotonically_increasing_id().alias("row"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, lines, size, at, name = [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            content = zip_stored([(DATA, b"".join(records)), (INDEX, "".join(lines).encode())])
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{name}.wacz"]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url_, payload_, response, row = (batch.column(c)[i].as_py() for c in range(5))
                refers = None if response is None or response == page else str(response)
                label = "" if page is None else str(page)
                name = row if name is None else name
                packed = record(label, url_, payload_, refers)
                lines.append(f"{label} 20000101000000 {json.dumps({'offset': at, 'length': len(packed), 'filename': 'data.warc.gz'})}\n")
                records.append(packed)
                at += len(packed)
                size += len(payload_)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, lines, size, at, name = [], [], 0, 0, None
        if records:
            yield close()

    return joined.mapInArrow(archive, "name string, content binary")


def read(archives: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(archive, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view = ZipView(memoryview(batch.column("content")[i].as_buffer()))
                data = view.member(DATA)
                found = []
                for line in bytes(view.member(INDEX)).decode().splitlines():
                    place = json.loads(line[line.index("{") :])
                    r = parse(bytes(data[place["offset"] : place["offset"] + place["length"]]))
                    number = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:")) else None
                    refers = r.get("WARC-Refers-To")
                    found.append((batch.column("name")[i].as_py(), number(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["kind"], r["bytes"], r["digest"], number(refers) if refers else None, r["payload"]))
                    if len(found) == 256:
                        yield _batch(found)
                        found = []
                if found:
                    yield _batch(found)

    slim = archives.select(F.col(name).alias("name"), F.col(content).alias("content"))
    return slim.mapInArrow(records, "archive string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["archive", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
