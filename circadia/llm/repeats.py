"""Repeated byte strings across documents, by suffix order and longest previous factors.

Texts are UTF-8 bytes; a string counts if it is ``LENGTH`` bytes long and starts at two places, which
may overlap, in one document or two. Matches never cross documents.

Equal strings must meet in one task. In every string of ``LENGTH`` bytes the 64-byte gram with the
smallest hash (the last of them) is its anchor, so equal strings have equal anchors at equal offsets.
A region is a run of strings with one anchor occurrence. Per anchor hash:

* a region content that occurs twice is repeated as a whole; nothing more is looked at;
* contents that differ under one anchor meet, each once, in tasks of bounded size. There the starts are put in the
  order of their suffixes (to ``LENGTH`` bytes, by doubling of ranks). A start's previous and next
  smaller position in that order give its longest earlier match, and here also its later ones;
* an anchor with more than ``MANY`` contents (the border of a passage that very many documents share)
  is not brought together: its strings are counted by 128 bits of hash.

``keep="first"`` removes bytes of strings that occur earlier (by doc_id, then the text's checksum, then
position) and so leaves the first occurrence; ``keep="none"`` removes all occurrences. Strings are
judged on the input, not on what is left.

Defined results: null text is empty; null doc_id comes last; rows equal in doc_id and text are one
document that occurs twice: ``none`` removes all of its strings, ``first`` keeps in both what the first
occurrence keeps; an empty table gives no rows. All columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .filters import bit_filter, in_filter
from .jaccard import one_per_partition
from .storage import held, width
from .text import binary_column, mixed, ranges, slices, utf8

LENGTH = 200
GRAM = 64
#: Distinct contents under one anchor up to which they are brought together.
MANY = 4096
#: Bytes of regions in a task of the suffix order, about.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xD1342543DE82EF95)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def _running(data: np.ndarray, base: np.uint64, salt: int) -> np.ndarray:
    """Sums of scrambled bytes times powers: substrings are hashed by differences."""
    table = mixed(np.arange(256).astype(np.uint64) + np.uint64(salt))
    size = 1 << max(16, int(len(data)).bit_length())
    return np.concatenate([[np.uint64(0)], np.cumsum(table[data] * _powers(int(base), size)[: len(data)], dtype=np.uint64)])


def _hashed(running: np.ndarray, inverse: np.uint64, at: np.ndarray, length) -> np.ndarray:
    size = 1 << max(16, int(len(running)).bit_length())
    return mixed((running[at + length] - running[at]) * _powers(int(inverse), size)[at])


class Regions:
    """The regions of a slice's texts: text, first start, number of starts, anchor and content hash."""

    def __init__(self, texts: pa.Array):
        self.data, self.places = utf8(texts)
        data, places = self.data, self.places
        grams, strings = LENGTH - GRAM + 1, len(data) - LENGTH + 1
        empty = np.empty(0, np.int64)
        self.text = self.start = self.count = empty
        self.anchor = self.content = np.empty(0, np.uint64)
        if strings <= 0:
            return
        with np.errstate(over="ignore"):
            self.running = _running(data, _BASE, 5)
            gram = _hashed(self.running, _INVERSE, np.arange(len(data) - GRAM + 1), GRAM)
            # smallest hash first, then the last position; 32 bits of the hash are enough to choose by
            packed = (gram >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(gram)).astype(np.uint64))
            span = 1
            while span * 2 <= grams:
                packed = np.minimum(packed[:-span], packed[span:])
                span *= 2
            if grams > span:
                packed = np.minimum(packed[: -(grams - span)], packed[grams - span :])
            chosen = (np.uint64(0xFFFFFFFF) - (packed & np.uint64(0xFFFFFFFF))).astype(np.int64)
            size = np.maximum(0, np.diff(places) - LENGTH + 1)
            starts = ranges(places[:-1], size)
            text = np.repeat(np.arange(len(size)), size)
            if not len(starts):
                return
            at = chosen[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            self.count = np.diff(np.append(first, len(starts)))
            self.begin = starts[first]
            self.text = text[first]
            self.start = self.begin - places[self.text]
            self.anchor = gram[at[first]]
            whole = _hashed(self.running, _INVERSE, self.begin, self.count + LENGTH - 1)
            self.content = mixed(whole ^ mixed((at[first] - self.begin).astype(np.uint64) * np.uint64(1 << 20) + self.count.astype(np.uint64)))


def _identity(docs: DataFrame) -> list[Column]:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text")]


def _packed(docs: DataFrame, numbers: np.ndarray) -> DataFrame:
    """Anchor and content hashes by bucket, packed, with their numbers; each pair at most twice from a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = Regions(part.column(0))
            order = np.lexsort((found.content, found.anchor))
            anchor, content = found.anchor[order], found.content[order]
            new = np.ones(len(order), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            first = np.flatnonzero(new)
            times = np.minimum(2, np.diff(np.append(first, len(order)))).astype(np.uint8)
            anchor, content = anchor[first], content[first]
            bucket = ((anchor >> np.uint64(32)) % np.uint64(len(numbers))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            line = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(line, len(order))
            if len(line):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[bucket[line]], pa.int32()), binary_column(anchor[order], ends * 8),
                     binary_column(content[order], ends * 8), binary_column(times[order], ends)],
                    names=["bucket", "anchors", "contents", "times"],
                )

    chosen = docs.select(F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(find, "bucket int, anchors binary, contents binary, times binary")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task's anchors: contents that occur twice, and the number of contents where there are several."""
    columns: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for i, kind in enumerate((np.uint64, np.uint64, np.uint8)):
            columns[i].append(np.frombuffer(b"".join(batch.column(i + 1).to_pylist()), kind))
    if not columns[0]:
        return
    anchor, content, times = (np.concatenate(c) for c in columns)
    order = np.lexsort((content, anchor))
    anchor, content, times = anchor[order], content[order], times[order]
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new = new_anchor | np.append(True, content[1:] != content[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(times.astype(np.int64), first)
    group = np.cumsum(new_anchor)[first] - 1
    several = np.bincount(group)
    lone = np.flatnonzero(new_anchor)
    many = several > 1
    twice = total > 1
    out_anchor = np.concatenate([anchor[first[twice]], anchor[lone[many]]]).view(np.int64)
    out_content = np.concatenate([content[first[twice]].view(np.int64), np.zeros(int(many.sum()), np.int64)])
    contents = np.concatenate([np.zeros(int(twice.sum()), np.int64), several[many]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(out_anchor), pa.array(out_content), pa.array(contents)], names=["anchor", "content", "contents"]
    )


def _regions(docs: DataFrame, sent, kind: str) -> DataFrame:
    """The regions that pass a bitmap: whole ones by content, those of several contents with their bytes,
    or the single strings of those under anchors with many contents."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, several, many = sent.value
        for part in slices(batches, "text"):
            found = Regions(part.column(2))
            anchor, content = found.anchor.view(np.int64), found.content.view(np.int64)
            if kind == "whole":
                rows = np.flatnonzero(in_filter(whole, content))
            else:
                is_many = in_filter(many, anchor) if many is not None else np.zeros(len(anchor), bool)
                rows = np.flatnonzero(is_many if kind == "strings" else in_filter(several, anchor) & ~is_many)
            if not len(rows):
                continue
            text = pa.array(found.text[rows])
            columns = [part.column(0).take(text), part.column(1).take(text), pa.array(found.start[rows]),
                       pa.array(found.count[rows], pa.int64())]
            names = ["doc_id", "key", "start", "count"]
            if kind == "strings":
                at = ranges(found.begin[rows], found.count[rows])
                back = np.repeat(np.arange(len(rows)), found.count[rows])
                with np.errstate(over="ignore"):
                    one = _hashed(found.running, _INVERSE, at, LENGTH)
                    two = _hashed(_running(found.data, _BASE2, 9), _INVERSE2, at, LENGTH)
                columns = [c.take(pa.array(back)) for c in columns[:2]]
                columns += [pa.array(at - found.places[found.text[rows[back]]]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                names = ["doc_id", "key", "start", "w1", "w2"]
            else:
                columns += [pa.array(anchor[rows]), pa.array(content[rows])]
                names += ["anchor", "content"]
                if kind == "several":
                    size = found.count[rows] + LENGTH - 1
                    taken = found.data[ranges(found.begin[rows], size)]
                    columns.append(binary_column(taken, np.concatenate([[0], np.cumsum(size)])))
                    names.append("bytes")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, key long, start long, "
    schema += "w1 long, w2 long" if kind == "strings" else "count long, anchor long, content long"
    return docs.select(*_identity(docs)).mapInArrow(find, schema + (", bytes binary" if kind == "several" else ""))


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each start's suffix, cut to ``length`` bytes, in their order; equal ones share a rank.

    Ranks of 8 bytes at every place, then of up to three times the length from three ranks (twice from
    two where the ranks are too many to go three to a number), until ``length``.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    places = len(data)
    key = np.zeros(places + length, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + places + length]
    known = 8
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        bits = int(rank.max()).bit_length() if len(rank) else 0
        times = 3 if 3 * bits <= 64 else 2
        reach = min(known * times, length)
        at = starts if reach == length else np.arange(places)
        rank = np.concatenate([rank, np.zeros(length, np.uint64)])
        key = rank[at]
        for k in range(1, times):
            key = (key << np.uint64(bits)) | rank[at + min(known * k, reach - known)]
        if reach == length:
            return np.unique(key, return_inverse=True)[1]
        known = reach


def previous_and_next(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each start's suffix equals one at an earlier, and at a later, position.

    In suffix order, ties by position, the nearest entry above with a smaller position is the start's
    previous smaller value, the one below its next smaller value; the longest previous factor is the
    longer match of the two. Suffixes are cut to one length here, so a factor of that length can only
    be the previous smaller value in the same run of equal ranks, which is the entry just above.
    """
    order = np.lexsort((position, rank))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = rank[order[1:]] == rank[order[:-1]]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order], later[order] = same[:-1], same[1:]
    return earlier, later


def _suffix_spans(keep: str):
    def spans(table: pa.Table) -> pa.Table:
        """Covered bytes of the regions of one task: doc_id, key, begin, end."""
        keys = [("doc_id", "ascending"), ("key", "ascending"), ("start", "ascending")]
        table = table.sort_by(keys).combine_chunks()  # nulls last: the order of documents
        data, places = utf8(table.column("bytes").combine_chunks())
        count = table.column("count").to_numpy()
        starts = ranges(places[:-1], count)
        region = np.repeat(np.arange(len(count)), count)
        rank = suffix_ranks(data, starts)
        earlier, later = previous_and_next(rank, np.arange(len(starts)))
        hit = np.flatnonzero(earlier if keep == "first" else earlier | later)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (region[hit[1:]] != region[hit[:-1]])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(hit))[: len(head)] - 1
        of = region[hit[head]]
        begin = table.column("start").to_numpy()[of] + starts[hit[head]] - places[of]
        end = begin + (hit[last] - hit[head]) + LENGTH
        rows = pa.array(of)
        return pa.table({"doc_id": table.column("doc_id").take(rows), "key": table.column("key").take(rows), "begin": begin, "end": end})

    return spans


def spans(docs: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, key and the repeated stretches (begin, end; they may overlap) of every document that has some."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    spark = docs.sparkSession
    parts = width(spark)
    found = _packed(docs, one_per_partition(spark, parts)).repartition(parts, "bucket")
    found = held(found.mapInArrow(_repeated, "anchor long, content long, contents long"), "repeats")
    whole = found.where("contents = 0")
    several = found.where(F.col("contents").between(2, MANY))
    many = found.where(F.col("contents") > MANY)
    has_many = many.limit(1).count() > 0
    sent = spark.sparkContext.broadcast(
        (bit_filter(whole, "content"), bit_filter(several, "anchor"), bit_filter(many, "anchor") if has_many else None)
    )
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "start")
    full = _regions(docs, sent, "whole").join(whole.select("anchor", "content"), ["anchor", "content"])
    if keep == "first":
        full = held(full, "repeats-whole")
        heads = full.groupBy("anchor", "content").agg(F.min(place).alias("_first"))
        full = full.join(heads, ["anchor", "content"]).where(place != F.col("_first"))
    out = full.select("doc_id", "key", F.col("start").alias("begin"), (F.col("start") + F.col("count") + LENGTH - 1).alias("end"))

    # Copies of a content are covered as a whole above; only its first one goes on, so that a group is as
    # large as its contents, however often they occur.
    regions = _regions(docs, sent, "several").groupBy("anchor", "content").agg(
        F.min_by(F.struct("doc_id", "key", "start", "count", "bytes"), place).alias("_r")
    )
    regions = held(regions.select("_r.*", "anchor", "content"), "repeats-regions")
    size = regions.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = max(1, -(-size // BLOCK_BYTES))
    dealt = regions.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
    order = dealt.groupBy("task").applyInArrow(_suffix_spans(keep), "doc_id long, key long, begin long, end long")
    out = out.unionByName(order)

    if has_many:
        strings = held(_regions(docs, sent, "strings"), "repeats-strings")
        twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1")
        hit = strings.join(twice, ["w1", "w2"])
        if keep == "first":
            hit = hit.where(place != F.col("_first"))
        out = out.unionByName(hit.select("doc_id", "key", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end")))
    return out


def _united(stretches: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in stretches or []):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def removed(docs: DataFrame, keep: str = "none") -> DataFrame:
    """row (all columns of ``docs``), n_bytes, spans (maximal removed runs: begin, end) and the kept bytes."""
    found = spans(docs, keep).distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("begin", "end")).alias("_found"))
    found = held(found, "repeats-spans").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    doc_id, key, _ = _identity(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("_id"), key.alias("_text_key"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, stretches in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist()):
                raw, gone = (text or "").encode(), _united(stretches)
                edges = [0, *(x for run in gone for x in run), len(raw)]
                sizes.append(len(raw))
                runs.append([{"begin": b, "end": e} for b, e in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "spans", "kept"],
            )

    chosen = joined.select("row", "_found")
    schema = chosen.select(
        "row", F.lit(0).cast("long").alias("n_bytes"),
        F.lit(None).cast("array<struct<begin: bigint, end: bigint>>").alias("spans"), F.lit(None).cast("binary").alias("kept"),
    ).schema
    return chosen.mapInArrow(cut, schema)
