"""Benchmark decontamination: documents that hold a benchmark item within an edit budget.

Texts are compared in lower case with every run of white space and ASCII punctuation as one blank. An item of m characters
may differ from a stretch of a document by up to ``floor(error_rate * m)`` edits. The item is cut into
one piece more than that, so every such stretch holds a piece unchanged: all pieces go into one
automaton, each hit names the stretch where the item could stand, and Myers' bit-parallel distance
decides there, over whole texts.

Items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters (or one item), with one
pass over the documents per block; nothing else is broadcast.

Defined results: null or empty items match nothing; null or empty documents hold nothing; repeated
documents and repeated items are matched as often as they occur; ties in distance go to the match that
ends first, and of its starts to the latest; empty tables give no rows. Null ids are kept. Other columns
are not read, or carried unread by ``clean``.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import picked
from .text import slices

ERROR_RATE = 0.05
BLOCK_CHARS = 4 << 20
MATCHES = "doc_id long, item_id long, distance int, budget int, start long, length int"


_BLANKED = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().encode().translate(_BLANKED).decode().split())


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of the places where the pattern has it."""
    out: dict[str, int] = {}
    for at, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << at
    return out


def distances(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Distance of the pattern to the best stretch that ends at each character of ``text``.

    Myers' algorithm: a column of the distance table as two bit vectors of vertical differences.
    ``anchored``: the stretch begins where ``text`` does.
    """
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score = full, 0, m
    for c in text:
        match = eq.get(c, 0)
        vertical = match | down
        across = (((match & up) + up) ^ up) | match
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1 | first) & full, less << 1 & full
        up, down = less | (full & ~(vertical | more)), more & vertical
        yield score


class Item:
    """A benchmark item and its pieces."""

    def __init__(self, item_id: int | None, text: str, error_rate: float):
        self.item_id, self.text = item_id, text
        self.budget = int(error_rate * len(text))
        cuts = [len(text) * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.eq = masks(text)

    def best(self, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, length) of the best match in ``text``, given where pieces place the item."""
        exact = text.find(self.text)
        if exact >= 0:
            return 0, exact, len(self.text)
        m, k, found = len(self.text), self.budget, None
        stretches: list[list[int]] = []
        for s in sorted(starts):
            a, b = max(0, s - k), min(len(text), s + m + k)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        for a, b in stretches:
            for at, score in enumerate(distances(self.eq, m, text[a:b]), a):
                if score <= k and (found is None or score < found[0]):
                    found = score, at + 1
        if found is None:
            return None
        score, end = found
        back = text[max(0, end - m - k) : end][::-1]
        for length, d in enumerate(distances(masks(self.text[::-1]), m, back, anchored=True), 1):
            if d == score:
                return score, end - length, length
        return score, end, 0  # the whole item deleted: only with a budget of its length


class Matcher:
    """All items of a block behind one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items = [Item(i, t, error_rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            for offset, piece in item.pieces:
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[Item, int, int, int]]:
        if not self.items or not text:
            return
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        for number in sorted(starts):
            found = self.items[number].best(text, list(starts[number]))
            if found:
                yield (self.items[number], *found)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of about ``BLOCK_CHARS`` characters, empty ones left out."""
    items = picked(benchmark, item_id="item_id", text="text").where("text is not null and text <> ''")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-total // BLOCK_CHARS)
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, count)))
    for block in range(count):
        rows = [(r.item_id, normal(r.text)) for r in items.where(share == block).toLocalIterator()]
        yield sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r))


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, sent, error_rate: float) -> Matcher:
    """The automaton of a block, made once per worker; ``name`` is the block's own in all jobs."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(sent.value, error_rate)
    return _MATCHERS[name]


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """Every pair of a document and an item that it holds: distance, budget, and where in the normal text."""
    spark, chosen = docs.sparkSession, picked(docs, doc_id="doc_id", text="text")
    out = spark.createDataFrame([], MATCHES)
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent, error_rate)
            for part in slices(batches, "text"):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for item, distance, start, length in matcher.matches(normal(text)):
                        rows.append((doc_id, item.item_id, distance, item.budget, start, length))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["doc_id", "item_id", "distance", "budget", "start", "length"]
                    )

        out = out.unionByName(chosen.mapInArrow(find, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without those that hold an item; decided row by row in one pass per block, no join."""
    spark, out = docs.sparkSession, docs
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent, error_rate)
            for part in slices(batches, "text"):
                good = [next(matcher.matches(normal(t)), None) is None for t in part.column(at).to_pylist()]
                if any(good):
                    yield part.filter(pa.array(np.array(good, bool)))

        out = out.mapInArrow(keep, docs.schema)
    return out
