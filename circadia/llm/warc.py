"""WARC archives in Zstandard with a shared dictionary, written and read back.

An archive begins with a skippable frame (0x184D2A5D) that holds the dictionary, itself compressed,
followed by one frame per record. Each task trains its archive's dictionary on the first records it
has (``SAMPLE_BYTES`` of them, a bound on training alone). A record whose payload equals that of a
record with a larger page_id is a ``revisit``: it has the HTTP header, with the full payload's length,
and the payload's digest, but not the payload, and refers to that record.

Archives are written with the file system that the folder's address names, under a name of their own
per task attempt; only names that the finished job reports are read.

Defined results: a null html is an empty payload; a null url has no target header and reads back as
null; among equal payloads all rows with the largest page_id are responses, so repeated rows of one
page_id do not revisit each other; null page_ids are smaller than all others and, among themselves,
equal. An empty table writes no archive and reads back empty. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import held, picked, scratch_path, width
from .wavelet import as_uri, make_folder

SKIPPABLE = 0x184D2A5D
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
ARCHIVE_BYTES = 32 << 20  # of compressed records, after which a task begins another archive
READ_BYTES = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
_ROWS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _field(value: str) -> bytes:
    """A header value on one line: percent signs and control characters are escaped."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value).encode()


def _value(field: bytes) -> str:
    first, *rest = field.decode().split("%")
    return first + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def to_record(page_id: int | None, url: str | None, payload: bytes, revisits: tuple[int | None] | None, date: str) -> bytes:
    """One WARC record; ``revisits`` holds the page_id that it repeats."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisits else b"response"),
        b"WARC-Record-ID: " + _name(page_id).encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _field(url))
    if revisits:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + _name(revisits[0]).encode()]
    else:
        block += payload
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in raw.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon or not key or key.lower() in out:
            raise ValueError(f"malformed or repeated header: {line[:80]!r}")
        out[key.lower()] = value.strip(b" ")
    return out


def from_record(raw: bytes) -> dict:
    """Fields of a record, or a ValueError that says what is wrong with it."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    headers = _headers(lines)
    if missing := {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"} - headers.keys():
        raise ValueError(f"missing headers: {sorted(missing)}")
    length = int(headers[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its Content-Length, or no blank lines end it")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    size = int(_headers(http.partition(b"\r\n")[2])[b"content-length"])
    kind, stated = headers[b"warc-type"].decode(), headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != stated):
        raise ValueError("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or b"warc-refers-to" not in headers):
        raise ValueError("a revisit with a payload, or of nothing")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind}")
    return {
        "page_id": _page(headers[b"warc-record-id"].decode()),
        "url": _value(headers[b"warc-target-uri"]) if b"warc-target-uri" in headers else None,
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": stated,
        "refers_to": _page(headers[b"warc-refers-to"].decode()) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading skippable frame and the dictionary; an empty frame where there is too little to train on."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        content = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    except (zstandard.ZstdError, ValueError):
        trained, content = None, b""
    return struct.pack("<II", SKIPPABLE, len(content)) + content, trained


def frames(source) -> Iterator[bytes]:
    """The records of an open archive, one frame each, read in pieces of ``READ_BYTES``."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    content, known = source.read(size), None
    if len(content) != size:
        raise ValueError("the dictionary frame is cut off")
    if content:
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content))
    press = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    frame, parts, begun = press.decompressobj(), [], False
    while data := source.read(READ_BYTES):
        while data:
            parts.append(frame.decompress(data))
            begun, data = True, b""
            if frame.eof:
                data = frame.unused_data
                yield b"".join(parts)
                frame, parts, begun = press.decompressobj(), [], False
    if begun:
        raise ValueError("the last frame is cut off")


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page; returns the manifest (path, records, payload_bytes), a written table.

    Only payloads that occur more than once are looked up again; the pages themselves meet them in a
    join that Spark can split where one payload is most of the pages.
    """
    spark = pages.sparkSession
    folder = as_uri(folder or scratch_path(spark, "warc"))
    make_folder(folder)
    chosen = picked(pages, page_id="page_id", url="url", html="html")
    chosen = chosen.withColumn("html", F.coalesce(F.col("html"), F.lit("")))
    chosen = chosen.withColumn("_digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    long_enough = F.octet_length("html") >= min_revisit_bytes
    repeated = (
        chosen.where(long_enough)
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_response"), F.count("*").alias("_copies"))
        .where("_copies > 1")
        .select("_digest", "_response", F.lit(True).alias("_again"))
    )
    joined = chosen.join(repeated, "_digest", "left")
    revisit = F.coalesce(F.col("_again") & ~F.col("page_id").eqNullSafe(F.col("_response")), F.lit(False))
    joined = joined.select("page_id", "url", "html", revisit.alias("_revisit"), "_response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, waiting, weight = TaskContext.get().partitionId(), uuid.uuid4().hex, [], 0
        out, press, path, records, payloads, written, archive = None, None, "", 0, 0, 0, 0

        def begin() -> None:
            nonlocal out, press, path, waiting, weight, written
            path = f"{folder}/{part:06d}-{archive:04d}-{attempt}.warc.zst"
            system, place = pafs.FileSystem.from_uri(path)
            out = system.open_output_stream(place)
            frame, known = dictionary_frame(waiting)
            press = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
            out.write(frame)
            for record in waiting:
                written += out.write(press.compress(record)) or 0
            waiting, weight, written = [], 0, out.tell()

        def end() -> pa.RecordBatch:
            nonlocal out, records, payloads, archive
            if out is None:
                begin()
            out.close()
            row = {"path": [path], "records": [records], "payload_bytes": [payloads]}
            out, records, payloads, archive = None, 0, 0, archive + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html, again, response = (batch.column(i)[at].as_py() for i in range(5))
                payload = html.encode()
                record = to_record(page_id, url, payload, (response,) if again else None, date)
                records, payloads = records + 1, payloads + len(payload)
                if out is None:
                    waiting.append(record)
                    weight += len(record)
                    if weight >= SAMPLE_BYTES:
                        begin()
                else:
                    out.write(press.compress(record))
                    if out.tell() >= ARCHIVE_BYTES:
                        yield end()
        if records:
            yield end()

    return held(joined.mapInArrow(write, "path string, records long, payload_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives, validated; the payload of a revisit is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = pafs.FileSystem.from_uri(path)
                rows, weight, seen = [], 0, 0
                with system.open_input_stream(place) as source:
                    for raw in frames(source):
                        rows.append(from_record(raw))
                        seen, weight = seen + 1, weight + len(raw)
                        if weight >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                            rows, weight = [], 0
                if seen != expected:
                    raise ValueError(f"{path} holds {seen} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    files = manifest.select("path", "records").repartition(width(manifest.sparkSession), "path")
    return files.mapInArrow(read, RECORDS)
