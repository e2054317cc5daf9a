"""Near-duplicate documents: word-shingle sets of Jaccard similarity 0.8 or more, exactly.

Sets are joined by partitioning the universe of shingles. Sizes fall into bands in which the larger is
at most 1.25 times the smaller, so a set links only within its band and the one below. Two linked sets
of sizes a and b differ in at most H = (a + b) / 9 shingles. A band hashes shingles to segments. A
segment that is equal in both sets costs nothing; where a segment is also indexed without each one of
its shingles, it is found with one difference, too. Equal segments count one and one-deletion segments
two; whenever a set's usable segments count more than H, no linked set can be missed. How many
segments a band has and how many of them get the one-deletion neighbourhood is what costs the
fewest signatures while nearly every set of the band has enough usable segments (``allocation``).

Empty segments are never indexed, and a one-deletion segment is usable from two shingles on. A set that
is left with too few usable segments is found another way: its band's sets also index the
smallest-hashed fifth of their shingles, of which linked sets share one, and those signatures count
where such a weak set has them. So no link is lost and none is judged by a sketch.

A signature that no other set has matches nothing. A set therefore needs to ask with its other
signatures only as far as those that it has alone do not already count more than H, and it asks with
the rarest of them: a set that shares some common passage and is otherwise its own asks nothing.

Sets that meet where one of them asks are candidates. They are not paired: candidates are gathered into
clusters, and a cluster's sets meet in blocks of bounded size, where all overlaps are counted through an
inverted index. Only what connects the verified links leaves a task.

Sets hold 64-bit hashes of shingles. Equal sets (128 bits of hash and the size) are one set throughout.

Defined results: words are lower-cased in A-Z; fewer than five words are one shingle; a text without
words, or null, has an empty set and no links; repeated rows are copies of each other; the component
of documents that all lack an id is null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .blocks import in_blocks
from .components import components, local_roots
from .filters import bit_filter, in_filter
from .storage import held, picked, width
from .text import binary_column, each, mixed, ranges, slices, words

WINDOW = 5
#: Shingles in a block of a cluster; a larger cluster is split, each pair of its blocks being a task.
BLOCK_SHINGLES = 2 << 20
#: Links that a task holds before it joins what they connect; near copies of one text all link to each other.
LINKS_HELD = 1 << 18
_LEAST = 4  # smaller sets link to equal ones only
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, each(distinct)), np.uint64, len(distinct))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    found = words(texts)
    count = len(found.first) - 1
    of, distinct = found.coded(lower=True)
    word = _hashes(distinct)[of] if len(of) else np.empty(0, np.uint64)
    text = found.text
    last = found.first[1:][text] - 1
    size = np.diff(found.first)
    with np.errstate(over="ignore"):
        # full windows, and the whole of a short text as one
        at = np.flatnonzero(np.arange(len(word)) + WINDOW - 1 <= last)
        full = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            full = mixed(full * _GOLD + word[at + k])
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        whole = size[short].astype(np.uint64)
        for k in range(WINDOW - 1):
            has = size[short] > k
            place = np.minimum(found.first[:-1][short] + k, max(len(word) - 1, 0))
            whole = np.where(has, mixed(whole * _GOLD + (word[place] if len(word) else whole)), whole)
    owner = np.concatenate([text[at], short])
    values = np.concatenate([full, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(count + 1))


def keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    with np.errstate(over="ignore"):
        size = np.diff(starts).astype(np.uint64)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ np.uint64(s)), dtype=np.uint64)]) for s in (11, 23)]
        one, two = (mixed(s[starts[1:]] - s[starts[:-1]] + size * _GOLD) for s in sums)
    return one.view(np.int64), two.view(np.int64)


# ---- size bands and their segments ---------------------------------------------------------------


def _bands() -> np.ndarray:
    out = [(_LEAST, _LEAST * 5 // 4)]
    while out[-1][1] < 1 << 40:
        low = out[-1][1] + 1
        out.append((low, low * 5 // 4))
    return np.array(out)


BANDS = _bands()


def differences(size, high):
    """Most shingles that a set of ``size`` can differ in from a linked one of at most its size and ``high``."""
    return (size + np.minimum(size, high)) // 9


@lru_cache(maxsize=None)
def allocation(low: int, high: int) -> tuple[int, int]:
    """(segments, how many of them with one-deletion neighbourhoods) of a band, by expected signatures.

    A set of n shingles puts Poisson(n / segments) into a segment. Usable segments must exceed the
    differences by three standard deviations at both ends of the band and of what probes it from above,
    and by a few more (``h // 16 + 2``), so that sets with a few shared signatures need not ask.
    """
    ends = [(n, int(differences(n, high))) for n in (low, high, high * 5 // 4)]
    top = max(h for _, h in ends)
    tried = range(1, 2 * top + 3) if top < 64 else [top * (100 + i) // 100 for i in range(1, 101)]
    best = None
    for m in tried:
        for d in sorted({m * i // 8 for i in range(9)}):
            fits = True
            for n, h in ends:
                x = n / m
                full, two = 1 - math.exp(-x), 1 - math.exp(-x) * (1 + x)
                units = (m - d) * full + 2 * d * two
                spread = math.sqrt((m - d) * full * (1 - full) + 4 * d * two * (1 - two))
                fits &= units - 3 * spread >= h + 1 + (h // 16 + 2 if top >= 16 else 0)
            cost = (m - d) + d * (1 + (low + high) / 2 / m)
            if fits and (best is None or cost < best[0]):
                best = cost, m, d
    if best is None:
        return 1, 1  # tiny sets: one segment, with every set but one shingle
    return best[1:]


class BandSets:
    """Sets of one slice that belong to or probe a band, cut into its segments."""

    def __init__(self, values: np.ndarray, owner: np.ndarray, size: np.ndarray, band: int):
        low, self.high = (int(x) for x in BANDS[band])
        self.values, self.owner, self.size, self.band = values, owner, size, band
        self.m, self.d = allocation(low, self.high)
        with np.errstate(over="ignore"):
            part = (mixed(values + np.uint64(band + 1) * _GOLD) >> np.uint64(33)) % np.uint64(self.m)
        self.cell = owner * self.m + part.astype(np.int64)
        self.sizes = np.bincount(self.cell, minlength=len(size) * self.m).reshape(len(size), self.m)
        plain, gapped = self.sizes[:, : self.m - self.d] > 0, self.sizes[:, self.m - self.d :] > 1
        self.need = differences(size, self.high) + 1
        self.spare = plain.sum(1) + 2 * gapped.sum(1) - self.need
        self.weak = self.spare < 0

    def signatures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment signatures (lowest bit 0), the sets they are of, and whether of a one-deletion segment."""
        m, d, sets = self.m, self.d, len(self.size)
        use = self.sizes > 0
        with np.errstate(over="ignore"):
            shown = mixed(self.values ^ np.uint64(77))
            sums = np.zeros(sets * m, np.uint64)
            np.add.at(sums, self.cell, shown)
            salt = mixed(np.arange(m).astype(np.uint64) + np.uint64(self.band * 1_000_003 + 7))
            row, part = np.nonzero(use)
            out, owner, gapped = [mixed(mixed(sums[row * m + part]) ^ salt[part])], [row], [part >= m - d]
            if d:
                part = self.cell - self.owner * m
                deep = (part >= m - d) & use.ravel()[self.cell] & (self.sizes.ravel()[self.cell] > 1)
                out.append(mixed(mixed(sums[self.cell[deep]] - shown[deep]) ^ salt[part[deep]]))
                owner.append(self.owner[deep])
                gapped.append(np.ones(int(deep.sum()), bool))
        return np.concatenate(out) & ~np.uint64(1), np.concatenate(owner), np.concatenate(gapped)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest-hashed shingles, of which two linked sets share one; the lowest bit is 1."""
        with np.errstate(over="ignore"):
            ranked = mixed(self.values ^ np.uint64(99))
            order = np.lexsort((ranked, self.owner))
            first = np.searchsorted(self.owner[order], np.arange(len(self.size)))
            place = np.arange(len(order)) - first[self.owner[order]]
            chosen = order[place < (self.size - -(-self.size * 4 // 5) + 1)[self.owner[order]]]
            return mixed(ranked[chosen] + np.uint64(self.band)) | np.uint64(1), self.owner[chosen]


def banded(values: np.ndarray, starts: np.ndarray) -> Iterator[tuple[BandSets, np.ndarray, bool]]:
    """The sets of a slice by band, once in their own band and once as probes of the one below."""
    size = np.diff(starts)
    band = np.where(size >= _LEAST, np.searchsorted(BANDS[:, 1], size), -1)
    owner = np.repeat(np.arange(len(size)), size)
    for b in np.unique(band[band >= 0]):
        rows = np.flatnonzero(band == b)
        local = np.full(len(size), -1)
        local[rows] = np.arange(len(rows))
        mine = local[owner] >= 0
        for target in (int(b), int(b) - 1):
            if target >= 0:
                yield BandSets(values[mine], local[owner[mine]], size[rows], target), rows, target == b


# ---- the join ------------------------------------------------------------------------------------

NARROW = "doc_id long, text_key binary, n_shingles long, k1 long, k2 long, spare_own int, spare_below int, weak array<int>"


def _identity(docs: DataFrame) -> DataFrame:
    """doc_id, text and a checksum of the text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key")
    )


def described(docs: DataFrame) -> DataFrame:
    """Size and 128-bit key of every document's set, how many usable segments it can spare in its own band
    and the one below, and the bands in which it is weak."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, starts = shingle_sets(part.column(1))
            one, two = keys(values, starts)
            weak: list[list[int]] = [[] for _ in range(part.num_rows)]
            spare = np.zeros((2, part.num_rows), np.int32)
            for sets, rows, own in banded(values, starts):
                spare[0 if own else 1, rows] = sets.spare
                for row in rows[sets.weak]:
                    weak[row].append(sets.band)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(starts)), pa.array(one), pa.array(two),
                 pa.array(spare[0]), pa.array(spare[1]), pa.array(weak, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "n_shingles", "k1", "k2", "spare_own", "spare_below", "weak"],
            )

    return _identity(docs).mapInArrow(describe, NARROW)


def one_per_partition(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` hash partitions a number that goes there, so that buckets share none."""
    numbers = spark.range(parts * 64).select(F.col("id").cast("int").alias("n"))
    found = numbers.groupBy(F.pmod(F.hash("n"), F.lit(parts)).alias("p")).agg(F.min("n").alias("n")).collect()
    return np.array(sorted(r["n"] for r in found), np.int32)


#: What is known of a signature: of a weak set's prefix, asking in the band below, of a one-deletion segment.
MARK, BELOW, GAPPED = 1, 2, 4
ENTRIES = "bucket int, kind string, ids binary, sigs binary, counts binary, flags binary"
_NAMES = ["bucket", "kind", "ids", "sigs", "counts", "flags"]


def _entry_rows(numbers: np.ndarray, bucket: np.ndarray, kind: str, ids, sigs, counts, flags) -> pa.RecordBatch:
    """Entries as one row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    line = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(line, len(order))
    columns = [binary_column(c[order], ends * c.dtype.itemsize) for c in (ids, sigs, counts, flags)]
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers[bucket[line]], pa.int32()), pa.array([kind] * len(line)), *columns], names=_NAMES
    )


def _entries(batches: Iterator[pa.RecordBatch], kind: str, others: list | None = None):
    """The entries of this kind, put together; rows of other kinds go to ``others``."""
    kinds = (np.int64, np.uint64, np.uint32, np.uint8)
    parts: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(1, 6)]
        for is_kind, *raw in zip(*rows):
            if is_kind == kind:
                for out, x, k in zip(parts, raw, kinds):
                    out.append(np.frombuffer(x, k))
            else:
                others.append(raw)
    return [np.concatenate(p) for p in parts]


def _by_signature(sig: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return ((sig >> np.uint64(32)) % np.uint64(len(numbers))).astype(np.int64)


def _by_set(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(len(numbers))).astype(np.int64)


def _packed_signatures(docs: DataFrame, weak_bands: frozenset[int], numbers: np.ndarray) -> DataFrame:
    """Signatures by bucket, packed: runs of a set and flags (``ids``, ``counts``, ``flags``) with their ``sigs``.

    A set that a task has already written is not written again, so copies cost little.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[bytes] = set()
        for part in slices(batches, "text"):
            values, starts = shingle_sets(part.column(0))
            one, two = keys(values, starts)
            names = [a.tobytes() + b.tobytes() for a, b in zip(one, two)]
            fresh = np.zeros(len(names), bool)
            for i, name in enumerate(names):
                fresh[i] = name not in written
                written.add(name)
            if len(written) > 1 << 20:
                written.clear()
            sigs, owners, flags = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
            for sets, rows, own in banded(values, starts):
                found, owner, gapped = sets.signatures()
                sigs.append(found)
                owners.append(rows[owner])
                flags.append((GAPPED * gapped + (0 if own else BELOW)).astype(np.uint8))
                if sets.band in weak_bands:
                    found, owner = sets.prefixes()
                    useful = np.ones(len(owner), bool) if own else sets.weak[owner]
                    sigs.append(found[useful])
                    owners.append(rows[owner[useful]])
                    flags.append((MARK * sets.weak[owner[useful]]).astype(np.uint8))
            sig, owner, flag = np.concatenate(sigs), np.concatenate(owners), np.concatenate(flags)
            keep = fresh[owner]
            sig, owner, flag = sig[keep], owner[keep], flag[keep]
            if not len(sig):
                continue
            bucket = _by_signature(sig, numbers)
            run_of = owner * 8 + flag
            order = np.lexsort((run_of, bucket))
            sig, owner, flag, bucket, run_of = (x[order] for x in (sig, owner, flag, bucket, run_of))
            run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(run_of, prepend=-1) != 0))
            count = np.diff(np.append(run, len(sig))).astype(np.uint32)
            line = np.flatnonzero(np.diff(bucket[run], prepend=-1))
            ends = np.append(line, len(run))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[bucket[run][line]], pa.int32()), pa.array(["signed"] * len(line)),
                 binary_column(one[owner[run]], ends * 8), binary_column(sig, np.append(run, len(sig))[ends] * 8),
                 binary_column(count, ends * 4), binary_column(flag[run], ends)],
                names=_NAMES,
            )

    return picked(docs, text="text").mapInArrow(sign, ENTRIES)


def _grouped(sig: np.ndarray) -> np.ndarray:
    """Number of the run of equal signatures, which are in order."""
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    return np.cumsum(new) - 1


def _shared(numbers: np.ndarray):
    """Of a task's signatures those that several sets have, with how many, dealt to their sets.

    Prefixes count only where a weak set has them, too.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sig, count, flag = _entries(batches, "signed")
        if not len(sig):
            return
        ids, flag = np.repeat(ids, count), np.repeat(flag, count)
        order = np.lexsort((flag, ids, sig))
        ids, sig, flag = ids[order], sig[order], flag[order]
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        ids, sig, flag = ids[first], sig[first], flag[first]  # once per set, in its own band if there
        group = _grouped(sig)
        sets = np.bincount(group)
        marked = np.zeros(len(sets), bool)
        marked[group[(flag & MARK) > 0]] = True
        keep = (sets[group] > 1) & (((sig & np.uint64(1)) == 0) | marked[group])
        ids, sig, flag, times = ids[keep], sig[keep], flag[keep], sets[group[keep]].astype(np.uint32)
        if len(sig):
            yield _entry_rows(numbers, _by_set(ids, numbers), "shared", ids, sig, times, flag)

    return shared


def _spare_rows(classes: DataFrame, numbers: np.ndarray) -> DataFrame:
    """What each set can spare, in the form of entries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, own, below = (batch.column(i).to_numpy() for i in range(3))
                yield _entry_rows(numbers, _by_set(ids, numbers), "spare", ids, own.astype(np.int64).view(np.uint64),
                                  below.astype(np.int32).view(np.uint32), np.zeros(len(ids), np.uint8))

    return classes.select("k1", "spare_own", "spare_below").mapInArrow(pack, ENTRIES)


def _asking(numbers: np.ndarray):
    """Of each set's shared signatures those it asks with, and those it only answers with, dealt by signature.

    A set can spare segments up to a number: it skips its most frequent signatures up to that.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: list = []
        ids, sig, times, flag = _entries(batches, "shared", others)
        if not len(sig):
            return
        known = np.concatenate([np.frombuffer(o[0], np.int64) for o in others])
        own = np.concatenate([np.frombuffer(o[1], np.uint64) for o in others]).view(np.int64)
        below = np.concatenate([np.frombuffer(o[2], np.uint32) for o in others]).view(np.int32)
        order = np.lexsort((np.minimum(own, below), known))  # of sets with one id the one that spares least
        known, own, below = known[order], own[order], below[order]
        new = np.append(True, known[1:] != known[:-1])
        first = np.flatnonzero(new)
        own, below, known = np.minimum.reduceat(own, first), np.minimum.reduceat(below, first), known[first]
        prefix = (sig & np.uint64(1)) == 1
        is_below = (flag & BELOW) > 0
        weight = np.where(prefix, 0, np.where((flag & GAPPED) > 0, 2, 1))
        order = np.lexsort((sig, -times.astype(np.int64), is_below, ids))
        ids, sig, prefix, is_below, weight = ids[order], sig[order], prefix[order], is_below[order], weight[order]
        at = np.searchsorted(known, ids)
        spare = np.where(is_below, below[at], own[at])
        group = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (is_below[1:] != is_below[:-1])))
        running = np.cumsum(weight)
        start = np.repeat(running[group] - weight[group], np.diff(np.append(group, len(ids))))
        asks = prefix | (running - start > spare)
        keep = asks | ~is_below
        ids, sig, asks = ids[keep], sig[keep], asks[keep].astype(np.uint8)
        if len(sig):
            yield _entry_rows(numbers, _by_signature(sig, numbers), "asking", ids, sig, np.zeros(len(sig), np.uint32), asks)

    return choose


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each task's buckets: every candidate set with the smallest set it hangs together with."""
    ids, sig, _, asks = _entries(batches, "asking")
    if not len(sig):
        return
    order = np.lexsort((ids, sig))
    ids, sig, asks = ids[order], sig[order], asks[order]
    group = _grouped(sig)
    keep = (np.bincount(group, asks) > 0)[group]
    ids, group = ids[keep], group[keep]
    near = np.flatnonzero((group[1:] == group[:-1]) & (ids[1:] != ids[:-1])) if len(ids) else np.empty(0, int)
    distinct, at = np.unique(np.concatenate([ids[near], ids[near + 1]]), return_inverse=True)
    root = local_roots(len(distinct), at[: len(near)], at[len(near) :])
    other = np.flatnonzero(root != np.arange(len(distinct)))
    yield pa.RecordBatch.from_arrays([pa.array(distinct[other]), pa.array(distinct[root[other]])], names=["a", "b"])


def _linked(names: np.ndarray, side: np.ndarray, copies: np.ndarray, values: np.ndarray, starts: np.ndarray):
    """Roots and numbers of linked documents of the sets of one task, all overlaps counted exactly.

    ``side`` is 0 and 1 for the two blocks of a pair, whose inner links other tasks find, or 2.
    """
    sets, size = len(names), np.diff(starts)
    owner = np.repeat(np.arange(sets), size)
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    token = np.empty(len(values), np.int64)
    token[order] = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(values))
    holders, count = owner[order], np.diff(first)
    root, a, b, links = np.arange(sets), [], [], np.zeros(sets, np.int64)
    waiting = 0

    def joined() -> np.ndarray:
        return local_roots(sets, np.concatenate([np.arange(sets), *a]), np.concatenate([root, *b]))

    for x in range(sets):
        mine = token[starts[x] : starts[x + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        length = count[mine]
        at = np.repeat(first[mine] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        met, shared = np.unique(holders[at], return_counts=True) if len(at) * 8 < sets else (None, None)
        if met is None:
            shared = np.bincount(holders[at], minlength=sets)
            met = np.flatnonzero(shared)
            shared = shared[met]
        good = 100 * shared >= 80 * (size[x] + size[met] - shared)
        good &= (met != x) & ((side[met] != side[x]) | (side[x] == 2))
        met = met[good]
        links[x] = copies[met].sum()
        met = met[met > x]  # from the other set it is the same link
        a.append(np.full(len(met), x))
        b.append(met)
        waiting += len(met)
        if waiting >= LINKS_HELD:
            root, a, b, waiting = joined(), [], [], 0
    return joined(), links


def _verify(table: pa.Table) -> pa.Table:
    """Sets of one task: each with its root here and its links."""
    names = np.stack([table.column("k1").to_numpy(), table.column("k2").to_numpy()], 1)
    side = table.column("side").to_numpy()
    _, chosen = np.unique(np.concatenate([names, side[:, None]], 1), axis=0, return_index=True)
    table = table.take(pa.array(chosen)).combine_chunks()
    names, side, copies = names[chosen], side[chosen], table.column("copies").to_numpy()
    data = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    root, links = _linked(names, side, copies, np.concatenate(data), starts)
    raw = [n.tobytes() for n in names.astype(">i8")]
    return pa.table({"a": pa.array(raw, pa.binary()), "b": pa.array([raw[r] for r in root], pa.binary()), "links": links})


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (k1, k2, ...) with the shingles of each set, taken from a document that has it.

    A bitmap of the wanted keys spares the other documents' sets the shuffle; a task writes a set once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "k1"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[bytes] = set()
        for part in slices(batches, "text"):
            values, starts = shingle_sets(part.column(0))
            one, two = keys(values, starts)
            rows = np.flatnonzero(in_filter(sent.value, one) & (np.diff(starts) > 0))
            names = [one[r].tobytes() + two[r].tobytes() for r in rows]
            fresh = []
            for r, name in zip(rows.tolist(), names):
                if name not in written:
                    written.add(name)
                    fresh.append(r)
            if len(written) > 1 << 20:
                written.clear()
            rows = np.array(fresh, np.int64)
            size = np.diff(starts)[rows]
            taken = values[ranges(starts[:-1][rows], size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[rows]), pa.array(two[rows]), binary_column(taken, np.concatenate([[0], np.cumsum(size)]) * 8)],
                names=["k1", "k2", "shingles"],
            )

    made = picked(docs, text="text").mapInArrow(sets, "k1 long, k2 long, shingles binary")
    return wanted.join(made, ["k1", "k2"])


def _labelled(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a set's key), component_id and n_links of every document."""
    spark = docs.sparkSession
    rows = held(described(docs), "jaccard-sets")
    weak = frozenset(r[0] for r in rows.select(F.explode("weak").alias("w")).distinct().collect())  # a few bands
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("spare_own").alias("spare_own"), F.first("spare_below").alias("spare_below"),
    )
    parts = width(spark)
    numbers = one_per_partition(spark, parts)
    deal = lambda df: df.repartition(parts, "bucket")
    shared = deal(_packed_signatures(docs, weak, numbers)).mapInArrow(_shared(numbers), ENTRIES)
    asking = deal(shared.unionByName(_spare_rows(classes, numbers))).mapInArrow(_asking(numbers), ENTRIES)
    candidates = held(deal(asking).mapInArrow(_stars, "a long, b long"), "jaccard-candidates")
    clusters = components(candidates)
    wanted = classes.drop("spare_own", "spare_below").join(clusters.withColumnRenamed("node", "k1"), "k1")
    wanted = held(wanted, "jaccard-wanted")
    # written, as dealing reads them more than once
    sets = held(_sets_of(docs, wanted), "jaccard-wanted-sets")
    dealt = in_blocks(sets, "component", "n_shingles", ["k2", "k1"], block)
    verified = held(
        dealt.groupBy("task", "large", "i", "j").applyInArrow(_verify, "a binary, b binary, links long"), "jaccard-links"
    )
    joined = components(verified.select("a", "b"))
    name = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("k1", "k2")])
    counted = verified.groupBy("a").agg(F.sum("links").alias("links"))
    labels = classes.withColumn("a", name).join(counted, "a", "left").join(joined.withColumnRenamed("node", "a"), "a", "left")
    labels = labels.withColumn("component", F.coalesce("component", "a"))
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(smallest, "component").select(
        "k1", "k2", "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = rows.join(labels, ["k1", "k2"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "text_key", "n_shingles", "component",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def linked(docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked to, copies included) of every document."""
    return _labelled(docs, block).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id (null last), then text checksum.

    Documents with empty sets all stay. Of rows that are equal in doc_id and text one stays.
    """
    rows = held(_labelled(docs, block), "jaccard-labels")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    full = rows.where("n_shingles > 0").withColumn("_place", place)
    heads = full.groupBy("component").agg(F.min("_place").alias("_head"))
    gone = full.join(heads, "component").where("_place <> _head").select(
        F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")
    )
    repeated = full.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias("_again"), F.col("text_key").alias("_again_key")
    )
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col("doc_id").cast("long").alias("_id"), key.alias("_key"))
    kept = whole.join(gone.distinct(), F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    if repeated.limit(1).count():
        again = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_key") == F.col("_again_key"))
        once = kept.join(repeated, again, "left_semi").dropDuplicates(["_id", "_key"])
        kept = kept.join(repeated, again, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
