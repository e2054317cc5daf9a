"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The packing of a length depends only on how many pieces of each length there are, and there are at
most ``capacity`` lengths. So the driver plans on that histogram, whatever the number of documents,
and every piece then looks up its place by its length and its rank among the pieces of that length.
The plan is the one that packing piece by piece in descending order gives:

1. Pieces above a third of the capacity stand at most two to a bin. The longest open one takes the
   longest partner that still fits (which pairs as many as possible); others stand alone.
2. Shorter pieces, longest first, go to the bin with the smallest gap that holds them, or open one.

Bins of equal content are handled together as a run of consecutive numbers.

Defined results: a null text is empty and gives one piece with the end id alone; repeated rows are
pieces of their own; an empty table gives no rows; ties in length are ranked by a hash of the key,
then by the key. Null keys are kept. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import held, picked, width
from .text import binary_column, slices
from .tokens import encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of each whole text with ``end_id`` behind, cut only where longer than ``capacity``.

    doc_id, piece (from 0), start (ids of the document before), length, ids (little-endian 32-bit).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for part in slices(batches, "text", keep=True):
            ids, at = encode(part.column(1))
            n = np.diff(at)
            # every text's ids, then its end id
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            text_end = at[1:] + np.arange(1, len(n) + 1) - 1
            body = np.ones(len(out), bool)
            body[text_end] = False
            out[body] = ids
            count = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = number * capacity
            length = np.minimum(n[row] + 1 - start, capacity)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)).cast(pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    binary_column(out, np.concatenate([[0], np.cumsum(length)]) * 4),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return picked(docs, doc_id="doc_id", text="text").mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """Where the pieces of each length go: runs of ranks, each to consecutive bins at one offset."""

    capacity: int
    bins: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, count: int, first_bin: int, offset: int) -> None:
        """The next ``count`` pieces of ``length`` go to bins first_bin, first_bin + 1, ... at ``offset``."""
        rank = self.used.get(length, 0)
        self.runs.setdefault(length, []).append((rank, first_bin, offset))
        self.used[length] = rank + count

    def opened(self, count: int) -> int:
        first, self.bins = self.bins, self.bins + count
        return first

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(runs, np.int64).T.copy() for length, runs in self.runs.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``histogram`` (pieces by length, each from 1 to ``capacity``)."""
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = Plan(capacity)
    left = {length: count for length, count in histogram.items() if count > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, count)

    def leave(first: int, count: int, gap: int) -> None:
        if count and gap:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        count = left[longest]
        # the longest partner that fits; lengths above a third pair at most once
        at = int(np.searchsorted(large, capacity - longest, "right")) - 1
        if at < 0:
            first = out.opened(count)
            out.put(longest, count, first, 0)
            leave(first, count, capacity - longest)
            large.pop()
            continue
        partner = large[at]
        pairs = min(count, left[partner]) if partner != longest else count // 2
        if pairs == 0:  # one piece, whose only partner of this length is itself
            if at > 0:
                partner, pairs = large[at - 1], 1
            else:
                first = out.opened(1)
                out.put(longest, 1, first, 0)
                leave(first, 1, capacity - longest)
                large.pop()
                continue
        first = out.opened(pairs)
        out.put(longest, pairs, first, 0)
        out.put(partner, pairs, first, longest)
        leave(first, pairs, capacity - longest - partner)
        left[longest] -= pairs
        left[partner] -= pairs
        large = [length for length in large if left[length]]

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        count = left[length]
        heap = [gap for gap in gaps if gap >= length]
        heapq.heapify(heap)
        while count:
            if not heap:
                each = capacity // length
                bins = -(-count // each)
                first = out.opened(bins)
                gaps.setdefault(capacity, []).append((first, bins))
                heapq.heappush(heap, capacity)
            gap = heap[0]
            runs = gaps[gap]
            first, bins = runs.pop()
            if not runs:
                del gaps[gap]
                heapq.heappop(heap)
            each = gap // length
            full = min(bins, count // each)
            for k in range(each if full else 0):
                out.put(length, full, first, capacity - gap + k * length)
            leave(first, full, gap - each * length)
            count -= full * each
            first, bins = first + full, bins - full
            if bins and count:  # fewer pieces than one more bin takes
                for k in range(count):
                    out.put(length, 1, first, capacity - gap + k * length)
                leave(first, 1, gap - count * length)
                count, first, bins = 0, first + 1, bins - 1
            leave(first, bins, gap)
    return out


def packed(items: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (any columns, a ``length`` among them) with sequence_id and offset.

    The items are written to the shared folder first: their number of each length is counted, planned
    on the driver (at most ``capacity`` numbers) and looked up again, and both must see the same rows.
    Ranks are counted within (length, share of the keys' hash), so no length meets in one task.
    """
    columns = items.columns
    shares = width(items.sparkSession)
    share = F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int")
    ranked = held(items.withColumn("_share", share), "packing")
    counts = ranked.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "packing-counts")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = plan(histogram, capacity).arrays()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, cuts[1:]) if len(order) else []:
                first, bins, offsets_ = runs[int(length[rows[0]])]
                at = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = bins[at] + rank[rows] - first[at]
                offset[rows] = offsets_[at]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    within = Window.partitionBy("length", "_share").orderBy(*keys)
    numbered = (
        ranked.withColumn("_rank", F.row_number().over(within))
        # both sides are dealt by these columns for their ranks; the offsets grow with the lengths and shares, so they are not sent
        .join(offsets.select("length", "_share", "_before").hint("merge"), ["length", "_share"])
        .withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    )
    schema = items.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.select(*columns, "_rank").mapInArrow(place, schema.schema)


def sequences(rows: DataFrame) -> DataFrame:
    """The training sequences themselves: the ids of each sequence in a row, at most a capacity of them.

    Takes ``packed`` rows that still carry ``ids``.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` packed, with a checksum in place of the ids: what the query returns."""
    made = pieces(docs, tokenizer, end_id, capacity)
    return packed(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
