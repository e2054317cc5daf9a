"""Language-model scores from Elias-Fano n-gram tries.

Words are lower-cased in A-Z; a text is its words and one end. The model is a back-off bigram model with
absolute discounting: a pair seen c times after a word seen n times, with t different successors, has
(c - D) / n; any other word has D * t / n times its add-one unigram probability (what back-off gives to
seen successors is not handed out again, so probabilities sum to at most one); after a word that was
never seen, the unigram probability alone.

The trie of a shard has two levels: words that have successors, and the successors of each. Word numbers
and the monotone pointers between the levels are Elias-Fano sequences; within the range that a pointer
pair gives, a successor is found by successor search on its number relative to the range. Probabilities
and back-off weights are stored as 16-bit steps of 1/4096 in log10. A shard's levels are one byte
string, memory-mapped while it answers.

The corpus is never gathered: counts and the occurrences that ask for them travel together to the shard
of the first word, packed by slice of documents, and what returns is a sum per document. Words that own
more than a share of all tokens are split by their successors over all shards; their totals are sums of
the shards' totals. Pairs that no training text has go on to the shard of their second word. Words are
64-bit hashes. Sums depend on the layout in their last digits only: a shard's are rounded to 1 / ``FINE``.

Defined results: null text is empty and scores its end; a null id counts as the empty text for the
held-out rule and is kept; rows equal in id and text get one result each; an empty table gives no rows;
with nothing to train on, all scores are the add-one rule's. Other columns are not read.
"""

from __future__ import annotations

import io
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .jaccard import one_per_partition
from .storage import held, width
from .text import each, ranges, slices, words

DISCOUNT = 0.75
STEP = 4096
#: Steps of a sum that a shard sends back: doubles do not compress. A text's sum is off by half a step per shard at most.
FINE = 2**30
#: Bytes of text in a slice: larger ones repeat fewer words in what is sent.
SLICE = 8 << 20
#: A word with more than 1 / (SPLIT * shards) of all tokens is split by its successors.
SPLIT = 4
TOP_WORDS = 64
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\x00begin"))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- Elias-Fano sequences and the trie -----------------------------------------------------------


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2**bits one after the other, little-endian bit order."""
    if not bits or not len(values):
        return np.zeros(0, np.uint8)
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(planes.ravel(), bitorder="little")


def unpack_bits(packed: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The numbers at the given places of ``packed``, which has eight spare bytes."""
    if not bits:
        return np.zeros(len(at), np.uint64)
    first = at * bits
    byte, shift = first >> 3, (first & 7).astype(np.uint64)
    word = np.zeros(len(at), np.uint64)
    for k in range(-(-(bits + 7) // 8)):
        word |= packed[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> shift) & np.uint64((1 << bits) - 1)


class EliasFano:
    """An ascending sequence: low bits packed, high bits in unary."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.size, self.low_bits, self.low = size, low_bits, low
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little")[: 8 * len(high)])
        upper = ones[:size] - np.arange(size)
        # where each high value begins; rebuilt on load from the unary bits
        top = int(upper[-1]) + 2 if size else 1
        self.begin = np.searchsorted(upper, np.arange(top + 1)).astype(np.int64)
        self.upper = upper

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        size = len(values)
        universe = int(values[-1]) + 1 if size else 1
        low_bits = max(0, (universe // max(size, 1)).bit_length() - 1)
        if low_bits > 56:
            raise ValueError("numbers too large")
        low = pack_bits(values.astype(np.uint64) & np.uint64((1 << low_bits) - 1), low_bits)
        upper = (values.astype(np.uint64) >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(int(upper[-1]) + size + 1 if size else 0, np.uint8)
        unary[upper + np.arange(size)] = 1
        high = np.packbits(unary, bitorder="little")
        low = np.concatenate([low, np.zeros(8, np.uint8)])
        return struct.pack("<QQQQ", size, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes()

    @classmethod
    def load(cls, raw: np.ndarray, at: int) -> tuple[EliasFano, int]:
        size, low_bits, n_low, n_high = struct.unpack("<QQQQ", raw[at : at + 32].tobytes())
        low = raw[at + 32 : at + 32 + n_low]
        high = np.asarray(raw[at + 32 + n_low : at + 32 + n_low + n_high])
        return cls(size, low_bits, low, high), at + 32 + n_low + n_high

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.upper[at] << self.low_bits) + unpack_bits(self.low, self.low_bits, at).astype(np.int64)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first entry not below each value (the size where there is none)."""
        high = np.minimum(values >> self.low_bits, len(self.begin) - 2)
        low = (values & ((1 << self.low_bits) - 1)).astype(np.uint64)
        over = values >> self.low_bits > high
        at, end = self.begin[high], self.begin[high + 1]
        at = np.where(over, self.size, at)
        open_ = np.flatnonzero((at < end) & ~over)
        while len(open_):
            less = unpack_bits(self.low, self.low_bits, at[open_]) < low[open_]
            open_ = open_[less]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return at


class Trie:
    """Words, their successors, quantised log10 probabilities and back-off weights, from one byte string."""

    def __init__(self, raw: np.ndarray):
        at = 0
        self.words, at = EliasFano.load(raw, at)
        self.pointers, at = EliasFano.load(raw, at)
        self.bases, at = EliasFano.load(raw, at)
        self.next, at = EliasFano.load(raw, at)
        n, m, v = self.words.size, self.next.size, struct.unpack("<Q", raw[at : at + 8].tobytes())[0]
        at += 8
        self.vocabulary = raw[at : at + 8 * v].view(np.uint64)
        at += 8 * v
        self.log_p = raw[at : at + 2 * m].view(np.uint16)
        at += 2 * m
        self.log_back = raw[at : at + 2 * n].view(np.uint16)

    @staticmethod
    def pack(first: np.ndarray, second: np.ndarray, log_p: np.ndarray, heads: np.ndarray, log_back: np.ndarray) -> bytes:
        """From pairs in ascending order of (first, second) and the back-off weight of each of ``heads``."""
        vocabulary = np.unique(np.concatenate([first, second]))
        a, b = np.searchsorted(vocabulary, first), np.searchsorted(vocabulary, second)
        words_ = np.searchsorted(vocabulary, heads)
        begin = np.searchsorted(a, words_)
        # a range's numbers are made ascending by adding the largest of all ranges before
        last = b[np.append(begin[1:], len(a)) - 1] + 1 if len(heads) else np.empty(0, np.int64)
        base = np.cumsum(last) - last
        following = b + np.repeat(base, np.diff(np.append(begin, len(a))))
        quantised = lambda x: np.minimum(65535, np.rint(-x * STEP)).astype(np.uint16)
        out = [EliasFano.pack(x) for x in (words_, np.append(begin, len(a)), np.append(base, base[-1] + last[-1] if len(base) else 0), following)]
        while (sum(map(len, out)) + 8) % 8:  # numbers of eight bytes begin at multiples of eight
            out[-1] += b"\x00"
            fixed = bytearray(out[-1])
            size = struct.unpack_from("<Q", fixed, 24)[0]
            struct.pack_into("<Q", fixed, 24, size + 1)
            out[-1] = bytes(fixed)
        out += [struct.pack("<Q", len(vocabulary)), vocabulary.tobytes(), quantised(log_p).tobytes(), quantised(log_back).tobytes()]
        return b"".join(out)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: log10 probability (0 if unseen), whether seen, and log10 weight of backing off."""
        number = lambda x: np.minimum(np.searchsorted(self.vocabulary, x), max(len(self.vocabulary) - 1, 0))
        if not self.words.size:
            return np.zeros(len(first)), np.zeros(len(first), bool), np.zeros(len(first))
        a, b = number(first), number(second)
        known_a, known_b = self.vocabulary[a] == first, self.vocabulary[b] == second
        head = self.words.successor(a)
        known_a &= head < self.words.size
        head = np.minimum(head, self.words.size - 1)
        known_a &= self.words.get(head) == a
        low, high, base = self.pointers.get(head), self.pointers.get(head + 1), self.bases.get(head)
        inside = known_a & known_b & (b + base < self.bases.get(head + 1))
        place = self.next.successor(np.where(inside, b + base, 0))
        seen = inside & (place >= low) & (place < high)
        place = np.minimum(place, self.next.size - 1)
        seen &= self.next.get(place) == b + base
        log_p = np.where(seen, self.log_p[place] / -STEP, 0.0)
        return log_p, seen, np.where(known_a & ~seen, self.log_back[head] / -STEP, 0.0)


def mapped(raw: bytes) -> tuple[Trie, io.IOBase]:
    """A trie on a memory-mapped file that vanishes with its handle."""
    file = tempfile.TemporaryFile()  # noqa: SIM115
    file.write(raw)
    file.flush()
    return Trie(np.memmap(file, np.uint8, "r")), file


# ---- what travels: packed columns of a slice -----------------------------------------------------


def _press(*columns: np.ndarray) -> bytes:
    """Arrays in one compressed byte string; wide numbers byte plane by byte plane, ascending hashes as their steps."""
    out = [struct.pack("<I", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c)
        if c.dtype == np.uint64:
            c = np.diff(c, prepend=np.uint64(0))  # wraps where they do not ascend, and back on reading
        planes = c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() if len(c) else b""
        out += [struct.pack("<cIQ", c.dtype.char.encode(), c.dtype.itemsize, len(c)), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpress(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, item, size = struct.unpack_from("<cIQ", data, at)
        at += struct.calcsize("<cIQ")
        planes = np.frombuffer(data, np.uint8, size * item, at).reshape(item, size)
        column = np.ascontiguousarray(planes.T).view(np.dtype(kind.decode())).ravel()
        out.append(np.cumsum(column, dtype=np.uint64) if column.dtype == np.uint64 else column)
        at += size * item
    return out


MESSAGE = "bucket int, kind string, slice long, payload binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("slice", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        yield int(bucket[rows[0]]), rows


class Slice:
    """Tokens of a slice: hashes of the distinct words, the word of each token, and the token's text."""

    def __init__(self, texts: pa.Array):
        found = words(texts)
        of, distinct = found.coded(lower=True)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, each(distinct)), np.uint64, len(distinct))
        hashes = np.concatenate([hashes, [END, BEGIN]]).astype(np.uint64)
        # words are numbered in the order of their hashes: what is sent of them ascends
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.hashes, of, (end, begin) = hashes[order], number[of], number[-2:]
        size = np.diff(found.first)
        self.tokens = size + 1
        self.word = np.full(int(self.tokens.sum()), end)
        last = np.cumsum(self.tokens) - 1
        body = np.ones(len(self.word), bool)
        body[last] = False
        self.word[body] = of
        self.text = np.repeat(np.arange(len(size)), self.tokens)
        self.before = np.empty(len(self.word), np.int64)
        self.before[1:] = self.word[:-1]
        self.before[last - self.tokens + 1] = begin


def _scan(docs: DataFrame, held_out: Column, tag: int, make) -> DataFrame:
    """Messages that ``make`` builds from every slice, and one that names the slice's documents."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), held_out.alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (tag << 56) | (TaskContext.get().partitionId() << 28)
        for part in slices(batches, "text", SLICE):
            # training texts come first, so a message tells them by their number
            out = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            part = part.take(pa.array(np.argsort(out, kind="stable")))
            cut, out = Slice(part.column(3)), np.sort(out)
            ids = part.column(0)
            names = _press(
                ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                part.column(1).to_numpy(), out.astype(np.uint8), cut.tokens.astype(np.int64),
            )
            yield _rows([(0, "names", number, names), *make(cut, out, number)])
            number += 1

    return chosen.mapInArrow(scan, MESSAGE)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal keys, in ascending order; and that order."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order[1:]] != keys[order[:-1]]) if len(keys) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(keys))), order


def _word_messages(numbers: np.ndarray):
    def make(cut: Slice, out: np.ndarray, number: int):
        texts, trained = len(out), np.array([np.count_nonzero(~out)], np.uint32)
        first, times, _ = _counted(cut.word * texts + cut.text)
        word, text = cut.word[first], cut.text[first]
        bucket = ((cut.hashes >> np.uint64(32)) % np.uint64(len(numbers))).astype(np.int64)
        for b, rows in _by_bucket(bucket[word]):
            w, t, k = word[rows], text[rows], times[rows]
            here, at = np.unique(w, return_index=True)
            yield (int(numbers[b]), "words", number, _press(
                cut.hashes[here], np.diff(np.append(at, len(w))).astype(np.uint32), t.astype(np.uint32), k.astype(np.uint32), trained))

    return make


def _pair_messages(numbers: np.ndarray, hot: np.ndarray):
    def make(cut: Slice, out: np.ndarray, number: int):
        parts, size, trained = np.uint64(len(numbers)), len(cut.hashes), np.array([np.count_nonzero(~out)], np.uint32)
        first, times, _ = _counted((cut.before * size + cut.word) * len(out) + cut.text)
        a, b, text = cut.before[first], cut.word[first], cut.text[first]
        own = ((cut.hashes >> np.uint64(32)) % parts).astype(np.int64)
        bucket = own[a]
        split = np.isin(cut.hashes, hot)[a]
        with np.errstate(over="ignore"):
            mixed_ = (cut.hashes[a[split]] * _GOLD) ^ cut.hashes[b[split]]
            bucket[split] = ((mixed_ * _GOLD >> np.uint64(32)) % parts).astype(np.int64)
        for k, rows in _by_bucket(bucket):
            x, y, t = a[rows], b[rows], text[rows]
            heads, at = np.unique(x, return_index=True)
            seconds, place = np.unique(y, return_inverse=True)
            yield (int(numbers[k]), "pairs", number, _press(
                cut.hashes[heads], np.diff(np.append(at, len(x))).astype(np.uint32), cut.hashes[seconds],
                place.astype(np.uint32), t.astype(np.uint32), times[rows].astype(np.uint32), trained))

    return make


def _messages(batches, *kinds: str):
    """(kind, slice, columns) of the rows of these kinds; others are handed on by the second list."""
    found, rest = [], []
    for batch in batches:
        for b, kind, number, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind in kinds:
                found.append((kind, number, _unpress(raw)))
            else:
                rest.append((b, kind, number, raw))
    return found, rest


def _sums(number: int, kind: str, text: np.ndarray, value: np.ndarray, *counts: np.ndarray) -> tuple[int, str, int, bytes]:
    """Sums of a slice's texts, for those that occur: of ``value`` as fixed-point numbers, signs in the last bit; of counts."""
    touched, at = np.unique(text, return_inverse=True)
    fixed = np.rint(np.bincount(at, value, len(touched)) * FINE).astype(np.int64)
    whole = [np.bincount(at, c, len(touched)).astype(np.uint32) for c in counts]
    return 0, kind, number, _press(touched.astype(np.uint64), (fixed << 1) ^ (fixed >> 63), *whole)


def _real(fixed: np.ndarray) -> np.ndarray:
    """The values of fixed-point numbers in a message."""
    return ((fixed >> 1) ^ -(fixed & 1)) / FINE


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard of words: counts of training tokens; per text the sum of log10(c + 1) and the known tokens."""
    kept, bucket = [], 0
    for batch in batches:
        kept.append(batch)
        of = batch.column(0).filter(pa.compute.equal(batch.column(1), "words"))
        bucket = of[0].as_py() if len(of) else bucket
    found, rest = _messages(kept, "words")
    if rest:
        yield _rows(rest)
    if not found:
        return
    hashes = [m[2][0] for m in found]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([0, *map(len, hashes)])
    total = np.zeros(len(distinct))
    spread = []
    for i, (_, _, (_, runs, text, times, trained)) in enumerate(found):
        word = np.repeat(at[ends[i] : ends[i + 1]], runs)
        spread.append(word)
        total += np.bincount(word, times * (text < trained[0]), len(distinct))
    for (_, number, (_, _, text, times, _)), word in zip(found, spread):
        yield _rows([_sums(number, "base", text, times * np.log10(total[word] + 1), times * (total[word] > 0))])
    seen = np.flatnonzero(total)
    top = seen[np.argsort(-total[seen], kind="stable")[:TOP_WORDS]]
    facts = _press(np.array([total.sum(), len(seen)]), distinct[top], total[top])
    yield _rows([(0, "facts", 0, facts)])
    yield _rows([(bucket, "counts", 0, _press(distinct[seen], total[seen].astype(np.int64)))])


def build(first: np.ndarray, second: np.ndarray, count: np.ndarray, totals: dict[int, tuple[float, float]]) -> bytes:
    """The trie of counted pairs (ascending); ``totals`` has count and successors of words split over shards."""
    heads, at = np.unique(first, return_index=True)
    runs = np.diff(np.append(at, len(first)))
    n = np.add.reduceat(count, at) if len(heads) else np.empty(0)
    t = runs.astype(float)
    for i, head in enumerate(heads.tolist()):
        if head in totals:
            n[i], t[i] = totals[head]
    return Trie.pack(first, second, np.log10(count - DISCOUNT) - np.repeat(np.log10(n), runs), heads, np.log10(DISCOUNT * t / n))


def _gathered(found) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a shard in ascending order, their training counts, and each message's pairs."""
    firsts = np.concatenate([np.repeat(m[0], m[1]) for _, _, m in found])
    seconds = np.concatenate([m[2][m[3]] for _, _, m in found])
    order = np.lexsort((seconds, firsts))
    new = np.append(True, (firsts[order[1:]] != firsts[order[:-1]]) | (seconds[order[1:]] != seconds[order[:-1]]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    weight = np.concatenate([m[5] * (m[4] < m[6][0]) for _, _, m in found])
    count = np.bincount(which, weight, len(head))
    return found, firsts[head], seconds[head], count, which


def _score_pairs(numbers: np.ndarray, hot: set[int]):
    """A shard of pairs: train on the training texts' pairs, then score all pairs that came with them.

    Pairs after words that are split over the shards are answered without their words' totals: those
    are known when all shards are done. They leave the logarithm of their discounted count and, unseen,
    a request; the totals are added per occurrence in the next step.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = _messages(batches, "pairs")
        if rest:
            yield _rows(rest)
        if not found:
            return
        found, first, second, count, which = _gathered(found)
        trained = count > 0
        whole = {h: (1.0, 1.0) for h in hot}
        trie, file = mapped(build(first[trained], second[trained], count[trained], whole))
        log_p, seen, back = trie.find(first, second)
        split = np.isin(first, np.fromiter(hot, np.uint64, len(hot)))
        # of a split word: its weight is not this shard's to give
        log_p[split & seen] = np.log10(count[split & seen] - DISCOUNT)
        back[split] = 0.0
        del trie
        file.close()
        facts = np.unique(first[split & trained], return_inverse=True)
        if len(facts[0]):
            yield _rows([(0, "split", 0, _press(facts[0], np.bincount(facts[1], count[split & trained]), np.bincount(facts[1]).astype(float)))])
        at, asked = 0, []
        for _, number, (_, _, _, _, text, times, _) in found:
            mine = which[at : at + len(text)]
            at += len(text)
            yield _rows([_sums(number, "score", text, times * (log_p[mine] + back[mine]))])
            ask = np.flatnonzero(~seen[mine] | split[mine])
            asked.append((mine[ask], np.full(len(ask), number), text[ask], times[ask]))
        # what all slices ask of one shard goes there together
        here, number, text, times = (np.concatenate(c) for c in zip(*asked))
        bucket = ((second[here] >> np.uint64(32)) % np.uint64(len(numbers))).astype(np.int64)
        for b, some in _by_bucket(bucket):
            some = some[np.lexsort((text[some], number[some], second[here[some]]))]
            pair = here[some]
            yield _rows([(int(numbers[b]), "asked", 0, _press(
                second[pair], np.where(split[pair], first[pair], np.uint64(0)), seen[pair].astype(np.uint8),
                number[some], text[some], times[some]))])

    return score


def _answer(totals: dict[int, tuple[float, float]], log_all: float):
    """A shard of words again: unigram probabilities of what was asked, and the totals of split words."""
    heads = np.array(sorted(totals), np.uint64)
    n = np.array([totals[int(h)][0] for h in heads])
    t = np.array([totals[int(h)][1] for h in heads])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = _messages(batches, "counts", "asked")
        if rest:
            yield _rows(rest)
        counts = [m for kind, _, m in found if kind == "counts"]
        word = np.concatenate([c[0] for c in counts]) if counts else np.empty(0, np.uint64)
        count = np.concatenate([c[1] for c in counts]).astype(float) if counts else np.empty(0)
        order = np.argsort(word)
        word, count = word[order], count[order]
        asked = [m for kind, _, m in found if kind == "asked"]
        if not asked:
            return
        second, first, seen, number, text, times = (np.concatenate(c) for c in zip(*asked))
        at = np.minimum(np.searchsorted(word, second), max(len(word) - 1, 0))
        c = np.where(word[at] == second, count[at], 0.0) if len(word) else np.zeros(len(second))
        value = np.where(seen == 0, np.log10(c + 1) - log_all, 0.0)
        if len(heads):
            h = np.minimum(np.searchsorted(heads, first), len(heads) - 1)
            split = heads[h] == first
            value += np.where(split, np.where(seen == 0, np.log10(DISCOUNT * t[h]), 0.0) - np.log10(n[h]), 0.0)
        value *= times
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            yield _rows([_sums(int(number[rows[0]]), "score", text[rows], value[rows])])

    return answer


_PART = "doc_id long, key long, held_out boolean, n_tokens long, base double, known long, score double"


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of every slice put together, one row per document."""
    found, _ = _messages(batches, "names", "base", "score")
    by: dict[int, dict[str, list]] = {}
    for kind, number, columns in found:
        by.setdefault(number, {}).setdefault(kind, []).append(columns)
    for kinds in by.values():
        ids, nulls, key, out, tokens = kinds["names"][0]
        base, known, score = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        for touched, logs, times in kinds.get("base", []):
            base[touched] += _real(logs)
            known[touched] += times
        for touched, value in kinds.get("score", []):
            score[touched] += _real(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(key, pa.int64()), pa.array(out.astype(bool)),
             pa.array(tokens if "base" in kinds else np.zeros(len(ids), np.int64), pa.int64()), pa.array(base), pa.array(np.rint(known).astype(np.int64)),
             pa.array(score)],
            names=["doc_id", "key", "held_out", "n_tokens", "base", "known", "score"],
        )


def seventh(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the documents for which ``held_out`` is false and scores all.
    """
    spark = docs.sparkSession
    parts = width(spark)
    numbers = one_per_partition(spark, parts)
    send = lambda df: df.repartition(parts, "bucket")
    words_ = held(send(_scan(docs, held_out, 1, _word_messages(numbers))).mapInArrow(_count_words, MESSAGE), "lm-words")
    tokens, vocabulary, frequent = 0.0, 0.0, {}
    for row in words_.where("kind = 'facts'").select("payload").collect():  # a few numbers per shard
        (n, v), top, count = _unpress(row["payload"])
        tokens, vocabulary = tokens + n, vocabulary + v
        frequent.update(zip(top.tolist(), count.tolist()))
    hot = {w for w, c in frequent.items() if c * SPLIT * parts > tokens}
    if docs_begin_often(words_, tokens, parts):
        hot.add(int(BEGIN))
    pairs = send(_scan(docs, held_out, 2, _pair_messages(numbers, np.fromiter(hot, np.uint64, len(hot)))))
    pairs = held(pairs.mapInArrow(_score_pairs(numbers, hot), MESSAGE), "lm-pairs")
    totals: dict[int, tuple[float, float]] = {}
    for row in pairs.where("kind = 'split'").select("payload").collect():  # a few words per shard
        for h, n, t in zip(*(c.tolist() for c in _unpress(row["payload"]))):
            a, b = totals.get(h, (0.0, 0.0))
            totals[h] = a + n, b + t
    log_all = float(np.log10(tokens + vocabulary + 1))
    counts = words_.where("kind = 'counts'")
    asked = pairs.where("kind = 'asked'").unionByName(counts)
    answered = send(asked).mapInArrow(_answer(totals, log_all), MESSAGE).where("kind = 'score'")
    sums = words_.where("kind in ('names', 'base')").unionByName(pairs.where("kind in ('names', 'score')")).unionByName(answered)
    rows = sums.repartition(parts, "slice").mapInArrow(_returned, _PART)
    # the two scans cut the documents differently; equal rows have equal sums in each
    whole = rows.groupBy("doc_id", "key", "held_out").agg(
        F.sum("n_tokens").alias("n"), F.sum("base").alias("b"), F.sum("known").alias("k"), F.sum("score").alias("s"),
        F.count_if(F.col("n_tokens") > 0).alias("times"),
    )
    each_ = lambda c: F.col(c) / F.col("times")
    tokens_of = each_("n").cast("long")
    out = whole.select(
        "doc_id", "held_out", tokens_of.alias("n_tokens"), each_("k").cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (each_("b") - tokens_of * F.lit(log_all)).alias("base_score"),
        each_("s").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_copy"),
    )
    return out.drop("_copy")


def docs_begin_often(words_: DataFrame, tokens: float, parts: int) -> bool:
    """Whether the beginnings of texts are frequent enough to be split."""
    ends = 0
    for row in words_.where("kind = 'facts'").select("payload").collect():
        _, top, count = _unpress(row["payload"])
        ends += sum(c for w, c in zip(top.tolist(), count.tolist()) if w == int(END))
    return ends * SPLIT * parts > tokens
