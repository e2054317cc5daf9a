"""Line deduplication across documents: lines within two edits of each other, found by their segments.

Lines are compared by code points, without white space at their ends. Two edits are near from
``MIN_LENGTH`` code points on. With ``graded``, as the query and the pipeline have it, every line with a
word takes part: two lines may be apart by one edit for each ``MIN_LENGTH / EDITS`` code points of the
shorter one, and by ``EDITS`` at most, so the shortest ones must be equal. Without it, lines shorter than
``MIN_LENGTH`` are left alone. A line of length l is cut into ``edits + 1`` segments. A line of length L within that
many edits, l <= L <= l + edits, holds one of them unchanged, and at few possible places, given the
lengths (the substrings that a left-to-right and a right-to-left alignment both allow). So every line
indexes its own segments and probes those substrings for each shorter length. Lines that meet are
gathered into clusters; a cluster's lines meet again in blocks of bounded size. Copies of a paragraph with
a word changed here and there all meet by segments, yet few pairs of them are near. So within a block
lines meet once more by variants: what a line becomes after up to two edits at the few places where it
leaves others of its family. Each pair with a variant in common that is not yet connected is decided by a
banded bit-parallel edit distance, many pairs at a time.

Lines linked directly or through others are one class. The first line of a class (smallest doc_id,
then its text's checksum, then line number) stays, all later ones go.

Defined results: null text has no lines; a null doc_id comes after all others; rows equal in doc_id and
text are one document and get the same result; a text's line breaks stay between the lines that stay;
an empty table gives no rows. ``deduplicated`` carries all columns as they are but text and, if there
is one, n_chars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import in_blocks
from .components import components, local_roots
from .filters import bit_filter, in_filter
from .jaccard import one_per_partition
from .storage import held, width
from .text import WHITE, binary_column, mixed, ranges, slices, utf8

EDITS = 2
MIN_LENGTH = 20
#: Code points in a block of a cluster.
BLOCK_CHARS = 1 << 20
#: White bytes at an end of a line that are passed one by one.
STEPS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Code points whose running hash is made at a time, so that it stays in the cache; powers up to there, and the commoner code points mixed.
_STEP = 1 << 16
_POWERS, _LIFTS = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_STEP, b)])) for b in (_BASE, _INVERSE))
_MIXED = mixed(np.arange(1 << 16))


def _inked(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines without white space at their ends; where all is white both are equal."""
    start, stop = begin.copy(), end.copy()
    ink = None
    for at, step in ((start, 1), (stop, -1)):
        live = np.flatnonzero(start < stop)
        for _ in range(STEPS):
            live = live[WHITE[data[at[live] - (step < 0)]]]
            at[live] += step
            live = live[start[live] < stop[live]]
        live = live[WHITE[data[at[live] - (step < 0)]]]
        if len(live):  # the next byte that is not white is looked up
            ink = np.flatnonzero(~WHITE[data]) if ink is None else ink
            place = np.searchsorted(ink, at[live])
            if step > 0:
                at[live] = np.minimum(np.append(ink, len(data))[place], stop[live])
            else:
                at[live] = np.maximum(np.append(0, ink + 1)[place], start[live])
    return start, stop


def _running(points: np.ndarray) -> np.ndarray:
    """Sums of mixed code points by powers of their places."""
    out = np.zeros(len(points) + 1, np.uint64)
    scales = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points) // _STEP, _POWERS[_STEP])]))
    for low, scale in zip(range(0, len(points), _STEP), scales):
        part = points[low : low + _STEP]
        common = part.max() < len(_MIXED)
        terms = np.take(_MIXED, part.astype(np.int64), mode="clip") if common else mixed(part)
        terms *= _POWERS[: len(part)]
        to = out[low + 1 : low + 1 + len(part)]
        np.cumsum(terms, out=to)
        to *= scale
        to += out[low]
    return out


class Lines:
    """The lines of a slice: byte places without outer white space, numbers in their texts, and keys."""

    def __init__(self, texts: pa.Array, min_length: int = MIN_LENGTH):
        data, places = utf8(texts)
        self.data = data
        filled = np.flatnonzero(np.diff(places) > 0)
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([breaks + 1, places[:-1][filled]])) if len(data) else np.empty(0, np.int64)
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data))[: len(begin)]
        start, stop = _inked(data, begin, end)
        inner = np.flatnonzero(data.view(np.int8) < -64)  # bytes that begin no code point
        length = stop - start - (np.searchsorted(inner, stop) - np.searchsorted(inner, start))
        chosen = (start < stop) & (length >= min_length)
        self.begin, self.start, self.stop, self.length = begin[chosen], start[chosen], stop[chosen], length[chosen]
        self.text = np.searchsorted(places, self.begin, "right") - 1
        line_starts = np.searchsorted(breaks, places[:-1])
        self.number = np.searchsorted(breaks, self.begin) - line_starts[self.text]
        self.raw = data.tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(self.raw[a:b]) for a, b in zip(self.start.tolist(), self.stop.tolist()))
        self.keys = np.frombuffer(digests, np.dtype([("k1", "<i8"), ("k2", "<i8")]))

    def code_points(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the chosen lines in a row, and where each begins."""
        packed = b"".join([self.raw[a:b] for a, b in zip(self.start[rows].tolist(), self.stop[rows].tolist())])
        if packed.isascii():
            points = np.frombuffer(packed, np.uint8).astype(np.uint32)
        else:
            points = np.frombuffer(packed.decode().encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum(self.length[rows])])


def budgets(edits: int, min_length: int, graded: bool) -> list[tuple[int, int, int]]:
    """Edits that are near where the shorter of two lines has low <= length < high: (low, high, edits)."""
    fewer = range(1, edits) if graded else ()
    return [(min_length * e // edits, min_length * (e + 1) // edits, e) for e in fewer] + [(min_length, 1 << 62, edits)]


def signatures(points: np.ndarray, starts: np.ndarray, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False):
    """Hashes of every line's segments and of the substrings that it probes, and the lines they are of."""
    start, length = starts[:-1], np.diff(starts)
    rows = np.arange(len(length))
    with np.errstate(over="ignore"):
        running = _running(points)
        far = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(points) // _STEP, _LIFTS[_STEP])]))

        def hashed(of: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
            # brought back to the first power, so that equal substrings at different places agree
            low = start[of] + at
            return (running[low + size] - running[low]) * (_LIFTS[low % _STEP] * far[low // _STEP])

        out, owner = [], []
        for lowest, highest, edits in budgets(edits, min_length, graded):
            pieces = edits + 1
            for shorter in range(edits + 1):
                fits = rows[(length - shorter >= lowest) & (length - shorter < highest)]
                size = length[fits] - shorter
                base, extra = size // pieces, size % pieces
                for k in range(pieces):
                    piece = base + (k >= pieces - extra)
                    offset = k * base + np.maximum(0, k - (pieces - extra))
                    low, high = max(-k, shorter - (edits - k)), min(k, shorter + (edits - k))
                    salt = mixed(size * (pieces + 1) + k)
                    for shift in range(low, high + 1):
                        at = offset + shift
                        inside = (at >= 0) & (at + piece <= length[fits])
                        of, where, span = fits[inside], at[inside], piece[inside]
                        out.append(mixed(hashed(of, where, span) ^ salt[inside]))
                        owner.append(of)
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def within(points: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Which pairs of lines a, b are at most ``edits`` apart.

    Bit-parallel columns of the distance table, of which only the band of 2 * edits + 1 diagonals is
    kept: bit o of a column stands for the diagonal o - edits. The distance is followed down the
    diagonal on which both lines end. All pairs advance together, a code point at a time.
    """
    length = np.diff(starts)
    swap = length[a] < length[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    m, n = length[a], length[b]
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(m - n <= edits)
    if not len(live):
        return out
    # each line between marks that equal nothing
    padded = np.full(len(points) + 2 * edits * len(length), 0xFFFFFFFF, np.uint32)
    shifted = starts[:-1] + edits * (2 * np.arange(len(length)) + 1)
    padded[ranges(shifted, length)] = points
    band = np.uint64((1 << (2 * edits + 1)) - 1)
    one = np.uint64(1)
    up = np.full(len(live), ((1 << (2 * edits + 1)) - 1) ^ ((1 << edits) - 1), np.uint64)
    down = np.zeros(len(live), np.uint64)
    score, last = (m - n)[live], (m - n + edits).astype(np.uint64)[live]
    pa_, pb, left = shifted[a[live]], shifted[b[live]], n[live]
    j = 0
    while len(live):
        done = left == j
        if done.any():
            out[live[done]] = score[done] <= edits
        go = ~done & (score <= edits)
        if not go.all():
            live, up, down, score, last = live[go], up[go], down[go], score[go], last[go]
            pa_, pb, left = pa_[go], pb[go], left[go]
            if not len(live):
                break
        c = padded[pb + j]
        match = np.zeros(len(live), np.uint64)
        for o in range(2 * edits + 1):
            match |= (padded[pa_ + (j - edits + o)] == c).astype(np.uint64) << np.uint64(o)
        same = ((((match & up) + up) ^ up) | match | down) & band  # diagonals that do not grow
        more, less = (down | ~(same | up)) & band, up & same
        next_ = same >> one
        up, down = (less | ~(next_ | more)) & band, next_ & more
        score = score + (one - ((same >> last) & one)).astype(np.int64)
        j += 1
    return out


class Hashes:
    """Running hashes of lines: of any stretch of a line, and of the line with stretches left out or put in."""

    def __init__(self, points: np.ndarray, starts: np.ndarray):
        self.points, self.start, self.length = points, starts[:-1], np.diff(starts)
        longest = int(self.length.max()) + 3 if len(self.length) else 3
        power = np.full(longest, _BASE)
        power[0] = 1
        self.power = np.cumprod(power)
        place = np.arange(len(points)) - np.repeat(self.start, self.length)
        terms = mixed(points.astype(np.uint64)) * self.power[place]
        self.running = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def between(self, line: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.running[self.start[line] + high] - self.running[self.start[line] + low]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many code points lines a and b begin with alike."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        none = np.zeros(len(a), np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            alike = self.between(a, none, middle) == self.between(b, none, middle)
            low, high = np.where(alike, middle, low), np.where(alike, high, middle - 1)
        return low

    def at(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The code point at a place, -1 behind the end."""
        inside = place < self.length[line]
        return np.where(inside, self.points[np.where(inside, self.start[line] + place, 0)].astype(np.int64), -1)


#: Lines of a group that are compared with all others of it before the one that it branches from is chosen.
TRIES = 8


def branches(hashes: Hashes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines leave others of their group: (line, place, what the others go on with, -1 where they end).

    Of each group one line is the trunk. The others leave it at some place; those that leave it at the same
    place with the same code point are a group again. So of any two lines of a group one leaves a trunk that
    the other one follows at their first difference, or both leave it there.
    """
    out = []
    line, turn = np.arange(len(group)), 0
    while True:
        order = np.argsort(group, kind="stable")
        line, group = line[order], group[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        line, first, size = line[np.repeat(size > 1, size)], first[size > 1], size[size > 1]
        if not len(line):
            break
        number = np.repeat(np.arange(len(first)), size)
        first = np.cumsum(size) - size
        trunk, place, best = np.zeros(len(first), np.int64), np.zeros(len(line), np.int64), np.full(len(first), -1)
        for n in range(TRIES):
            chance = mixed(np.arange(len(first)).astype(np.uint64) + np.uint64((turn * TRIES + n + 1) << 32))
            other = line[first + (chance % size.astype(np.uint64)).astype(np.int64)]
            alike = hashes.common(line, other[number])
            total = np.add.reduceat(alike, first)
            better = total > best
            trunk, best = np.where(better, other, trunk), np.where(better, total, best)
            place = np.where(better[number], alike, place)
        leaves = line != trunk[number]
        line, place, number = line[leaves], place[leaves], number[leaves]
        out.append((line, place, hashes.at(trunk[number], place)))
        own = hashes.at(line, place)
        order = np.lexsort((own, place, number))
        keys = np.stack([number, place, own])[:, order]
        group = np.empty(len(line), np.int64)
        group[order] = np.cumsum(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(line) else order
        turn += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


#: Variants that are held at a time.
VARIANTS = 1 << 21


def variants(points: np.ndarray, starts: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the lines of each group after up to two edits, their lines and numbers of edits; what meets none is left out.

    Two lines of a group that are at most two edits apart have a variant in common: the first edit is where
    they first differ, the last one where they last do. Of two lines one leaves a trunk there, from the left
    and from the right, so only edits at the few places where a line leaves a trunk are made: the line's own
    code point goes, the trunk's comes, or both. Where both lines leave the trunk, both let theirs go. Two
    code points that come side by side after one that is equal to the second (``ab`` and ``abcb``) have no last
    difference of their own; they go or come together. Each yield is a share of the hashes.
    """
    with np.errstate(over="ignore"):
        hashes = Hashes(points, starts)
        length, count = hashes.length, len(group)
        left_line, left, left_new = branches(hashes, group)
        # the lines from right to left are in the opposite order, too
        right_line, right, right_new = branches(Hashes(points[::-1], len(points) - starts[::-1]), group[::-1])
        right_line = count - 1 - right_line
        order = np.argsort(right_line, kind="stable")
        right_line, right, right_new = right_line[order], right[order], right_new[order]
        first = np.searchsorted(right_line, np.arange(count + 1))
        both = first[left_line + 1] - first[left_line]
        l_of, r_of = np.repeat(np.arange(len(left_line)), both), ranges(first[left_line], both)
        salt = mixed(group.astype(np.uint64) + np.uint64(1))
        shift = np.array([int(_INVERSE) ** 2 % 2**64, int(_INVERSE), 1, int(_BASE), int(_BASE) ** 2 % 2**64], np.uint64)
        none = np.zeros(count, np.int64)
        everyone, at_left, at_right = np.arange(count), np.zeros(len(left_line), np.int64), np.zeros(len(right_line), np.int64)

        def made(line, p, new_p, gone_p, q, new_q, gone_q):
            """line[:p], new_p, line[p + gone_p : -q - gone_q], new_q, line[-q:], and whose they are."""
            ends = length[line] - q - gone_q
            fits = p + gone_p <= ends
            if new_p is not None:
                fits &= new_p >= 0
            if new_q is not None:
                fits &= new_q >= 0
            line, p, q, ends = line[fits], p[fits], q[fits], ends[fits]
            come = new_p is not None
            value = hashes.between(line, none[line], p)
            if come:
                value = value + mixed(new_p[fits].astype(np.uint64)) * hashes.power[p]
            value = value + hashes.between(line, p + gone_p, ends) * shift[2 + come - gone_p]
            if new_q is not None:
                value = value + mixed(new_q[fits].astype(np.uint64)) * hashes.power[ends + come - gone_p]
            more = come - gone_p + (new_q is not None) - gone_q
            value = value + hashes.between(line, length[line] - q, length[line]) * shift[2 + more]
            return mixed(value ^ salt[line]), line

        kinds = [(True, 1), (True, 0), (False, 1)]  # another comes, one's own goes

        def every() -> Iterator[tuple[tuple[np.ndarray, np.ndarray], int]]:
            yield made(everyone, none, None, 0, none, None, 0), 0
            for come, gone in kinds:
                yield made(left_line, left, left_new if come else None, gone, at_left, None, 0), 1
                yield made(right_line, at_right, None, 0, right, right_new if come else None, gone), 1
                for come_q, gone_q in kinds:
                    p, q = left[l_of], right[r_of]
                    new_p, new_q = left_new[l_of] if come else None, right_new[r_of] if come_q else None
                    yield made(left_line[l_of], p, new_p, gone, q, new_q, gone_q), 2
            inner = np.flatnonzero(left > 0)
            line, p, new = left_line[inner], left[inner], left_new[inner]
            before = hashes.at(line, p - 1)
            # both at the place: the trunk's and again the one before it come, or two go of which the second is that one
            yield made(line, p, new, 0, length[line] - p, before, 0), 2
            goes = hashes.at(line, p + 1) == before
            yield made(line[goes], p[goes], None, 2, at_left[inner][goes], None, 0), 2

        shares = 1 + (count + 3 * (len(left_line) + len(right_line)) + 9 * len(l_of)) // VARIANTS
        for share in range(shares):
            values, owners, edits = [], [], []
            for (value, line), n in every():
                mine = np.flatnonzero((value >> np.uint64(32)) % np.uint64(shares) == share) if shares > 1 else slice(None)
                values.append(value[mine])
                owners.append(line[mine])
                edits.append(np.full(len(owners[-1]), n, np.int8))
            value, owner, n = np.concatenate(values), np.concatenate(owners), np.concatenate(edits)
            order = np.argsort(value, kind="stable")
            value = value[order]
            again = value[1:] == value[:-1]
            meets = np.append(again, False) | np.append(False, again)
            yield value[meets], owner[order][meets], n[order][meets]


def _groups(sig: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in groups of equal signatures, in the order of rank: owners, first places and sizes of groups of more than one."""
    order = np.lexsort((rank, owner, sig))
    sig, owner, rank = sig[order], owner[order], rank[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner, rank = sig[fresh], owner[fresh], rank[fresh]
    order = np.lexsort((rank, sig))  # stable, so owners stay in order
    sig, owner = sig[order], owner[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    return owner, first[size > 1], size[size > 1]


def classes_in(
    points: np.ndarray, starts: np.ndarray, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False
) -> np.ndarray:
    """Root of each line of a block: all pairs that may be near and are not yet connected are decided.

    Pairs that share a signature may be near, but of copies of a paragraph with a word changed here and there
    few pairs are. So up to two edits only those of them are decided that have a variant in common, too.
    """
    count, length = len(starts) - 1, np.diff(starts)
    root = np.arange(count)
    sig, owner = signatures(points, starts, edits, min_length, graded)
    owner, first, size = _groups(sig, owner, np.zeros(len(sig), np.int8))
    if edits <= 2 and len(first):
        member = owner[ranges(first, size)]
        families = local_roots(count, np.repeat(owner[first], size), member)
        chosen = np.unique(member)
        flat, places = points[ranges(starts[chosen], length[chosen])], np.concatenate([[0], np.cumsum(length[chosen])])
        owners, firsts, sizes = zip(*[_groups(*found) for found in variants(flat, places, families[chosen])])
        before = np.cumsum([0, *map(len, owners)])
        owner, size = chosen[np.concatenate(owners)], np.concatenate(sizes)
        first = np.concatenate([at + n for at, n in zip(firsts, before)])
    tried = np.empty(0, np.int64)
    turn = 0
    while len(first):
        # in this turn the turn-th line of each group meets the others of its group
        head = owner[first + turn]
        group = np.repeat(np.arange(len(first)), size)
        member = owner[ranges(first, size)]
        a, b = head[group], member
        apart = root[a] != root[b]
        pair = np.unique(np.minimum(a, b)[apart] * count + np.maximum(a, b)[apart])
        pair = pair[~np.isin(pair, tried)]
        if len(pair):
            tried = np.union1d(tried, pair)
            a, b = pair // count, pair % count
            least = np.minimum(length[a], length[b])
            for lowest, highest, budget in budgets(edits, min_length, graded):
                rows = np.flatnonzero((least >= lowest) & (least < highest))
                rows = rows[within(points, starts, a[rows], b[rows], budget)]
                root = local_roots_from(root, a[rows], b[rows])
        low = np.minimum.reduceat(root[member], np.cumsum(size) - size)
        high = np.maximum.reduceat(root[member], np.cumsum(size) - size)
        turn += 1
        open_ = (low != high) & (size > turn)
        first, size = first[open_], size[open_]
    return root


def local_roots_from(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after more edges."""
    at = np.arange(len(root))
    return local_roots(len(root), np.concatenate([at, a]), np.concatenate([root, b]))


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    return F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every line that takes part: doc_id, text_key, line (its number in the text), k1 and k2 (of its content)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = Lines(part.column(2), min_length)
            rows = pa.array(found.text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(found.number, pa.int32()),
                 pa.array(found.keys["k1"].copy()), pa.array(found.keys["k2"].copy())],
                names=["doc_id", "text_key", "line", "k1", "k2"],
            )

    doc_id, key = _identity(docs)
    chosen = docs.select(doc_id.alias("doc_id"), key.alias("text_key"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(find, "doc_id long, text_key binary, line int, k1 long, k2 long")


def _packed(docs: DataFrame, numbers: np.ndarray, edits: int, min_length: int, graded: bool = False) -> DataFrame:
    """Signatures by bucket, packed; a line that a task has already written is not written again."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for part in slices(batches, "text"):
            found = Lines(part.column(0), budgets(edits, min_length, graded)[0][0])
            _, rows = np.unique(found.keys["k1"], return_index=True)
            rows = rows[[k not in written for k in found.keys["k1"][rows].tolist()]] if len(rows) else rows
            written.update(found.keys["k1"][rows].tolist())
            if len(written) > 1 << 20:
                written.clear()
            if not len(rows):
                continue
            sig, owner = signatures(*found.code_points(rows), edits, min_length, graded)
            # small numbers are sorted in one pass
            bucket = ((sig >> np.uint64(32)) % np.uint64(len(numbers))).astype(np.min_scalar_type(len(numbers)))
            order = np.argsort(bucket, kind="stable")
            sig, ids, bucket = sig[order], found.keys["k1"][rows][owner[order]], bucket[order]
            line = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(line, len(sig)) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[bucket[line]], pa.int32()), binary_column(ids, ends), binary_column(sig, ends)],
                names=["bucket", "ids", "sigs"],
            )

    chosen = docs.select(F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(sign, "bucket int, ids binary, sigs binary")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each task's buckets: every line that meets another with the smallest it hangs together with."""
    ids, sigs = [], []
    for batch in batches:
        ids.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64))
        sigs.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64))
    if not sigs:
        return
    one, sig = np.concatenate(ids), np.concatenate(sigs)
    order = np.argsort(sig, kind="stable")
    one, sig = one[order], sig[order]
    near = np.flatnonzero((sig[1:] == sig[:-1]) & (one[1:] != one[:-1]))
    distinct, at = np.unique(np.concatenate([one[near], one[near + 1]]), return_inverse=True)
    root = local_roots(len(distinct), at[: len(near)], at[len(near) :])
    other = np.flatnonzero(root != np.arange(len(distinct)))
    yield pa.RecordBatch.from_arrays([pa.array(distinct[other]), pa.array(distinct[root[other]])], names=["a", "b"])


def _candidate_texts(docs: DataFrame, filter_: np.ndarray, min_length: int) -> DataFrame:
    """k1, k2 and code points of the lines whose key passes the filter, once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = Lines(part.column(0), min_length)
            passes = np.flatnonzero(in_filter(sent.value, found.keys["k1"]))
            _, first = np.unique(found.keys[passes], return_index=True)
            rows = passes[first]
            points, starts = found.code_points(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys["k1"][rows]), pa.array(found.keys["k2"][rows]), binary_column(points, starts * 4)],
                names=["k1", "k2", "points"],
            )

    chosen = docs.select(F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(find, "k1 long, k2 long, points binary")


def near_classes(
    docs: DataFrame, edits: int = EDITS, min_length: int = MIN_LENGTH, block: int = BLOCK_CHARS, *, graded: bool = False
) -> DataFrame:
    """(k1, k2, class) of the lines that have a different line within ``edits`` edits in their class."""
    spark = docs.sparkSession
    parts = width(spark)
    packed = _packed(docs, one_per_partition(spark, parts), edits, min_length, graded).repartition(parts, "bucket")
    candidates = held(packed.mapInArrow(_meetings, "a long, b long"), "line-candidates")
    clusters = components(candidates).withColumnsRenamed({"node": "k1", "component": "cluster"})
    shortest = budgets(edits, min_length, graded)[0][0]
    texts = _candidate_texts(docs, bit_filter(clusters, "k1"), shortest).dropDuplicates(["k1", "k2"])
    wanted = held(texts.join(clusters, "k1").withColumn("weight", F.octet_length("points") / 4), "line-texts")

    def verify(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint32) for x in table.column("points").to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        root = classes_in(np.concatenate(data), starts, edits, min_length, graded)
        names = np.stack([table.column("k1").to_numpy(), table.column("k2").to_numpy()], 1).astype(">i8")
        raw = [n.tobytes() for n in names]
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array([raw[i] for i in other], pa.binary()), "b": pa.array([raw[root[i]] for i in other], pa.binary())})

    dealt = in_blocks(wanted, "cluster", "weight", ["k1", "k2"], block)
    links = held(dealt.groupBy("task", "large", "i", "j").applyInArrow(verify, "a binary, b binary"), "line-links")
    joined = components(links)
    part = lambda c, at: F.conv(F.hex(F.substring(c, at, 8)), 16, -10).cast("long")
    return joined.select(part(F.col("node"), 1).alias("k1"), part(F.col("node"), 9).alias("k2"), F.col("component").alias("class"))


def line_classes(docs: DataFrame, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False) -> DataFrame:
    """Every line that takes part with its class and ``later``: whether an earlier line of the class exists."""
    lines = held(occurrences(docs, 1 if graded else min_length), "lines")
    near = near_classes(docs, edits, min_length, graded=graded)
    own = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("k1", "k2")])
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")
    # each content once, with its first place; only contents that are repeated or near another go on
    contents = lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    contents = contents.join(near, ["k1", "k2"], "left").withColumn("near", F.col("class").isNotNull())
    shared = held(contents.where("near or n > 1").withColumn("class", F.coalesce("class", own)), "line-contents")
    heads = shared.groupBy("class").agg(F.min("first").alias("head"))
    shared = shared.join(heads, "class").select("k1", "k2", "class", "head", "near")
    marked = lines.join(shared, ["k1", "k2"], "left")
    later = F.col("head").isNotNull() & ~(F.col("head") == place)
    return marked.select(
        "doc_id", "text_key", "line", F.coalesce("class", own).alias("class"),
        F.coalesce("near", F.lit(False)).alias("near"), F.coalesce(later, F.lit(False)).alias("later"),
    )


def summaries(docs: DataFrame, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False) -> DataFrame:
    """doc_id, text_key, n_lines, n_near and the numbers of the lines that go, of each document with lines."""
    return line_classes(docs, edits, min_length, graded).dropDuplicates(["doc_id", "text_key", "line"]).groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_lines"),
        F.count_if("near").alias("n_near"),
        F.sort_array(F.collect_list(F.when(F.col("later"), F.col("line")))).alias("gone"),
    )


def without(text: str | None, gone: list[int] | None) -> str | None:
    """``text`` without the lines of these numbers; the others keep their breaks."""
    if not gone:
        return text
    drop = set(gone)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)


def deduplicated(docs: DataFrame, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False) -> DataFrame:
    """row (all columns of ``docs``), n_lines, n_near, n_removed and the new text of every document."""
    doc_id, key = _identity(docs)
    found = held(summaries(docs, edits, min_length, graded), "line-summaries").withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("_id"), key.alias("_text_key"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column(0).field("text").to_pylist(), batch.column(3).to_pylist()
            new = pa.array([without(t, g) for t, g in zip(text, gone)], pa.string())
            removed = pa.array([len(g or []) for g in gone], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), removed, new],
                names=["row", "n_lines", "n_near", "n_removed", "kept_text"],
            )

    chosen = joined.select(
        "row", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "gone"
    )
    schema = chosen.select(
        "row", "n_lines", "n_near", F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")
    ).schema
    schema["kept_text"].nullable = True
    return chosen.mapInArrow(rewrite, schema)


def filtered(docs: DataFrame, edits: int = EDITS, min_length: int = MIN_LENGTH, graded: bool = False) -> DataFrame:
    """``docs`` with the texts that are left; a document whose words have all gone with its lines goes, too."""
    rows = deduplicated(docs, edits, min_length, graded)
    worded = "[^\\x20\\x09-\\x0D]"
    stays = F.col("kept_text").rlike(worded) | (F.col("n_removed") == 0)
    columns = []
    for field in docs.schema:
        column = F.col(f"row.`{field.name}`")
        if field.name == "text":
            column = F.col("kept_text").cast(field.dataType)
        elif field.name == "n_chars":
            column = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(field.dataType)).otherwise(column)
        columns.append(column.alias(field.name))
    return rows.where(stays | F.col("kept_text").isNull()).select(*columns)
