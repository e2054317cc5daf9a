"""Token shards as wavelet matrices: one compressed file per shard that answers access, counts and places.

A shard holds the ids of consecutive documents. Plane by plane from the highest bit, the ids' bits are
written in the current order, and the ids are then stably parted into zeros and ones. With the number
of ones before each 512-bit block, rank is a lookup and a popcount, and an id's occurrences in any
range are found by following its bits down (counting) or up (places).

File: b"WMX1", a little-endian header length, a JSON header (sizes, section lengths), then sections,
each compressed on its own with zstandard: document ids and nulls, document ends, and one per plane.
A plane can be read without the others.

Shard files are numbered in ascending doc_id order (nulls first). They are written with the file
system that the folder's address names, under a name of their own per task attempt; only the names
that the finished job reports are ever read, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .storage import held, picked, scratch_path, width
from .text import binary_column, slices
from .tokens import encoder

MAGIC = b"WMX1"
BLOCK = 512
#: Ids in a shard at most, unless one document has more.
SHARD_TOKENS = 1 << 20
MANIFEST = "part int, shard int, path string, docs long, tokens long"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Bits:
    """A bit plane with rank and select."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size
        padded = np.zeros(-(-max(size, 1) // BLOCK) * (BLOCK // 8) + BLOCK // 8, np.uint8)
        padded[: len(packed)] = packed
        self.bytes = padded
        blocks = _ONES[padded].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(blocks)])
        self.ones = int(self.before[-1])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        inside = self.bytes.reshape(-1, BLOCK // 8)[block]
        bits = np.unpackbits(inside, axis=-1)
        mask = np.arange(BLOCK) < (at - block * BLOCK)[..., None]
        return self.before[block] + (bits & mask).sum(-1, dtype=np.int64)

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the ``nth`` (from 0) one or zero."""
        nth = np.asarray(nth, np.int64)
        before = self.before if bit else np.arange(len(self.before)) * BLOCK - self.before
        block = np.searchsorted(before, nth, "right") - 1
        bits = np.unpackbits(self.bytes.reshape(-1, BLOCK // 8)[block], axis=-1)
        seen = np.cumsum(bits == bit, axis=-1, dtype=np.int64)
        return block * BLOCK + (seen <= (nth - before[block])[..., None]).sum(-1)


class WaveletMatrix:
    """Ids by bit planes, the highest bit first."""

    def __init__(self, planes: list[np.ndarray], size: int):
        self.size, self.depth = size, len(planes)
        self.raw = planes
        self._bits: list[Bits | None] = [None] * len(planes)

    def plane(self, level: int) -> Bits:
        if self._bits[level] is None:
            self._bits[level] = Bits(self.raw[level], self.size)
        return self._bits[level]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, order = [], ids
        for level in range(depth):
            ones = (order & order.dtype.type(1 << (depth - 1 - level))) != 0
            planes.append(np.packbits(ones))
            order = order.take(np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)]))
        return cls(planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: the reverse of the stable partings."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        order = np.zeros(self.size, kind)
        for level in range(self.depth - 1, -1, -1):
            ones = np.unpackbits(self.raw[level], count=self.size).view(bool)
            zeros = self.size - int(np.count_nonzero(ones))
            above = np.empty(self.size, kind)
            above[np.flatnonzero(~ones)] = order[:zeros]
            above[np.flatnonzero(ones)] = order[zeros:] | kind(1 << (self.depth - 1 - level))
            order = above
        return order

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.depth):
            bits = self.plane(level)
            one, rank = bits.get(at).astype(bool), bits.rank1(at)
            value = value * 2 + one
            at = np.where(one, self.size - bits.ones + rank, at - rank)
        return value

    def _span(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` from [first, last) stand below the last plane."""
        if token >> self.depth:
            return 0, 0
        for level in range(self.depth):
            bits = self.plane(level)
            low, high = bits.rank1(np.array([first, last])).tolist()
            if token >> (self.depth - 1 - level) & 1:
                zeros = self.size - bits.ones
                first, last = zeros + low, zeros + high
            else:
                first, last = first - low, last - high
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of ``token`` in [first, last)."""
        low, high = self._span(token, first, self.size if last is None else last)
        return high - low

    def places(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """All places of ``token`` in [first, last), ascending."""
        low, high = self._span(token, first, self.size if last is None else last)
        at = np.arange(low, high)
        for level in range(self.depth - 1, -1, -1):
            bits, zeros = self.plane(level), self.size - self.plane(level).ones
            one = token >> (self.depth - 1 - level) & 1
            at = bits.select(one, at - zeros if one else at)
        return at


@dataclass
class Shard:
    """Documents of one file: their ids (and which are null), the end of each, and all their tokens."""

    doc_ids: np.ndarray
    nulls: np.ndarray
    ends: np.ndarray
    matrix: WaveletMatrix


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.of(ids)
    sections = [np.diff(doc_ids, prepend=0).tobytes(), np.packbits(nulls).tobytes(), np.diff(ends, prepend=0).tobytes()]
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(s) for s in sections + [p.tobytes() for p in matrix.raw]]
    header = {"docs": len(doc_ids), "tokens": len(ids), "depth": matrix.depth, "sections": [len(p) for p in parts]}
    header["crc32"] = zlib.crc32(b"".join(parts))
    text = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])


def from_bytes(raw: bytes) -> Shard:
    if raw[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack_from("<I", raw, 4)[0]
    header, at, parts = json.loads(raw[8 : 8 + size]), 8 + size, []
    if zlib.crc32(raw[at:]) != header["crc32"] or len(raw) - at != sum(header["sections"]):
        raise ValueError("the token shard is damaged")
    press = zstandard.ZstdDecompressor()
    for length in header["sections"]:
        parts.append(press.decompress(raw[at : at + length]))
        at += length
    docs = np.cumsum(np.frombuffer(parts[0], np.int64))
    nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=header["docs"]).view(bool)
    ends = np.cumsum(np.frombuffer(parts[2], np.int64))
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return Shard(docs, nulls, ends, WaveletMatrix(planes, header["tokens"]))


def write_file(path: str, raw: bytes) -> None:
    system, place = pafs.FileSystem.from_uri(path)
    with system.open_output_stream(place) as out:
        out.write(raw)


def read_file(path: str) -> bytes:
    system, place = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as source:
        return source.read()


def as_uri(path: str) -> str:
    """The address in the form that file systems are found by: a plain path or ``file:/...`` is local."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def make_folder(path: str) -> None:
    system, place = pafs.FileSystem.from_uri(path)
    system.create_dir(place, recursive=True)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Tokenize, order by doc_id and write the shards; returns the manifest, one row per file.

    Documents are range-partitioned by doc_id, so each task writes its own run of files. A manifest row
    has part and shard (the order of the files), path, docs and tokens. The manifest is a written table.
    """
    spark = docs.sparkSession
    folder = as_uri(folder or scratch_path(spark, "token-shards"))
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part, shard, held_docs, held_ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held_docs, held_ids, size
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wmx"
            ids = np.concatenate(held_ids)
            column = pa.concat_arrays([d for d, _ in held_docs])
            ends = np.cumsum(np.concatenate([n for _, n in held_docs]))
            write_file(path, to_bytes(
                column.fill_null(0).to_numpy(zero_copy_only=False),
                column.is_null().to_numpy(zero_copy_only=False), ends, ids))
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "path": [path], "docs": [len(ends)], "tokens": [len(ids)]},
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()),
                                  ("docs", pa.int64()), ("tokens", pa.int64())]))
            shard, held_docs, held_ids, size = shard + 1, [], [], 0
            return row

        for rows in slices(batches, "text", keep=True):
            ids, at = encode(rows.column(1))
            count = np.diff(at) + 1
            out = np.full(len(ids) + len(count), end_id, np.uint16)
            body = np.ones(len(out), bool)
            body[np.cumsum(count) - 1] = False
            out[body] = ids
            if size and size + len(out) > shard_tokens:
                yield flush()
            held_docs.append((rows.column(0).cast(pa.int64()), count))
            held_ids.append(out)
            size += len(out)
        if held_docs:
            yield flush()

    chosen = picked(docs, doc_id="doc_id", text="text")
    ordered = chosen.repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id")
    return held(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: tokens of all files before. Totals of the parts first, then within parts."""
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("_all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    totals = totals.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        manifest.withColumn("_shard_start", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(totals, "part")
        .withColumn("start", F.col("_part_start") + F.col("_shard_start"))
        .drop("_part_start", "_shard_start")
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents back from the files: doc_id, start (global), n_tokens and ids (32-bit little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = from_bytes(read_file(path))
                ids = shard.matrix.decode().astype(np.uint32)
                begins = np.concatenate([[0], shard.ends])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls),
                        pa.array(begins[:-1] + start, pa.int64()),
                        pa.array(np.diff(begins), pa.int64()),
                        binary_column(ids, begins * 4),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    files = starts(manifest).select("path", "start")
    files = files.repartition(width(manifest.sparkSession), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
