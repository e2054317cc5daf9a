"""Bytes, lines and words of Arrow text columns as numpy arrays, a bounded slice at a time.

A word is a run of bytes other than space and 0x09 to 0x0D, the same for every operator here.
Null texts are empty. Texts are never cut: a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text may exceed it.
SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each value starts (one more than values)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system, which the allocators of a waiting worker would hold beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim is not None:
        trim(0)


#: What a worker keeps from task to task of one kind of work, such as encoders with their words.
KEPT: dict = {}


def slices(batches, column: str, limit: int = SLICE_BYTES, *, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The record batches again, cut so that ``column`` holds at most ``limit`` bytes or one row.

    A worker outlives its stage. So work that does not use what is ``KEPT`` (``keep``) lets it go first,
    and memory that is free behind the last slice goes back to the system.
    """
    if KEPT and not keep:
        KEPT.clear()
        gc.collect()  # what was kept may hang together in cycles
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        first, rows = 0, batch.num_rows
        while first < rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    give_back()


@dataclass
class Words:
    """Words of a slice: byte places [start, end) and, per text, [first, first of the next)."""

    data: np.ndarray
    places: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Row of each word's text in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def column(self, lower: bool = False) -> pa.Array:
        """The words as a binary column."""
        keep = ~WHITE[self.data]
        packed = self.data[keep]
        if lower:
            packed = LOWER[packed]
        at = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=at[1:])
        return pa.Array.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(packed)]
        )

    def coded(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """Number of each word among the distinct words of the slice, and those words."""
        coded = self.column(lower).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words(texts: pa.Array) -> Words:
    data, places = utf8(texts)
    inside = ~WHITE[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        # a text's first byte starts a word, its last one ends it, whatever the next text begins with
        heads = places[:-1][np.diff(places) > 0]
        start[heads] = inside[heads]
        tails = places[1:][np.diff(places) > 0] - 1
        end[tails] = inside[tails]
    begins = np.flatnonzero(start)
    return Words(data, places, begins, np.flatnonzero(end) + 1, np.searchsorted(begins, places))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, then starts[1] .., as one index array."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def each(values: pa.Array) -> list[bytes]:
    """The values of a binary column as bytes objects."""
    data, places = utf8(values)
    raw, at = data.tobytes(), places.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in each(distinct)), np.uint64, len(distinct))


def listed(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds values[starts[i]:starts[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


def binary_column(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes data[starts[i]:starts[i+1]]."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data.view(np.uint8))]
    )
