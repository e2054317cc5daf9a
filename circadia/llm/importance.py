"""Drawing documents that look like a target: importance weights over hashed n-grams.

Texts are lower-cased (A-Z), split and dictionary-encoded by Arrow, a slice of whole texts at a time. A word is a
number of the slice's dictionary, a pair of neighbours is two such numbers, and a run of three is a pair's number
and a word's: shifted against themselves and dictionary-encoded again, so the checksum of a run is made once
for each distinct pair, from those of its two parts (the CRC of a concatenation follows from the CRCs and the length
of the second part; no run is ever written out). A text's weight is a segment sum over the gains taken by the dictionary numbers.

One pass over the texts leaves every text's buckets (two bytes a feature) in the shared folder. They are counted, a task
sending one row per bucket at most, so the gains are two numbers a bucket on the driver, whatever the corpus; then
every text is weighed. Weights are whole numbers, so nothing depends on the layout. The drawn ones are the highest weights after Gumbel noise from
a checksum of the id: rows are put in order in ranges and numbered by the rows of the ranges before (no window or task sees
all of them).

Defined results: null and empty texts have no words and no features (weight 0, never drawn); a null id has the noise
of an empty one and comes last among ties; rows that are equal throughout get different ranks; a text of any
length is one slice; tables without rows count nothing, and an empty corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from circadia.operators.ranking import number_rows

from .storage import held, picked
from .text import binary_column, each, ranges, slices, utf8

#: What stands between words: everything in ASCII but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: Reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _byte_step() -> np.ndarray:
    """What a zero byte makes of each byte of a checksum: 4 x 256 values whose exclusive or is the new one."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(_POLYNOMIAL), low >> 1).astype(np.uint32)
    shifted = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) >> np.uint32(8) for k in range(1, 4)]
    return np.stack([low, *shifted])


def _apply(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = step[0][crc & 255]
    for k in range(1, 4):
        out = out ^ step[k][(crc >> np.uint32(8 * k)) & 255]
    return out


_STEPS = [_byte_step()]


def _zeros(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums after ``lengths`` zero bytes, by powers of two of them."""
    crc = crc.copy()
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        while len(_STEPS) <= bit:
            whole = np.arange(256, dtype=np.uint32)
            _STEPS.append(np.stack([_apply(_STEPS[-1], _apply(_STEPS[-1], whole << np.uint32(8 * k))) for k in range(4)]))
        at = np.flatnonzero((lengths >> bit) & 1)
        crc[at] = _apply(_STEPS[bit], crc[at])
    return crc


_BLANK = np.uint32(zlib.crc32(b" "))


class Runs:
    """The runs of 1 to ``longest`` words of a slice: for each length the checksums of the distinct runs, the
    number of every occurrence among them, and the row of its text."""

    def __init__(self, texts: pa.Array, longest: int = LONGEST):
        self.rows = len(texts)
        lower = pc.ascii_lower(texts.fill_null(""))
        lists = pc.split_pattern_regex(lower, pattern=BREAKS)
        flat = pc.list_flatten(lists)
        row = np.repeat(np.arange(self.rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        strings = each(coded.dictionary)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        worded = size[code] > 0 if len(code) else np.zeros(0, bool)
        code, row = code[worded], row[worded]
        crc = np.fromiter(map(zlib.crc32, strings), np.uint32, len(strings))
        # a blank and the word, which is what a longer run has more than the run before it
        follows = _zeros(np.full(len(crc), _BLANK, np.uint32), size) ^ crc
        self.n_words = np.bincount(row, minlength=self.rows)
        self.found = [(crc, code, row)]
        whole, at = crc, code
        for n in range(2, longest + 1):
            here = row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)
            last = code[n - 1 :][here]
            pairs = at[: len(here)][here] * max(len(crc), 1) + last
            kinds = pa.array(pairs).dictionary_encode()
            distinct = kinds.dictionary.to_numpy(zero_copy_only=False)
            left, right = distinct // max(len(crc), 1), distinct % max(len(crc), 1)
            longer = _zeros(whole[left], size[right] + 1) ^ follows[right]
            number = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.found.append((longer, number, row[: len(here)][here]))
            # places without a run of n words have none of n + 1 either
            at = np.full(len(here), -1, np.int64)
            at[here] = number
            whole = longer

    def buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of every text's features, text after text, and where each text's begin (one more than texts)."""
        times = [np.bincount(row, minlength=self.rows) for _, _, row in self.found]
        starts = np.concatenate([[0], np.cumsum(sum(times))])
        out = np.empty(starts[-1], _stored(buckets))
        begin = starts[:-1].copy()
        for (crc, number, _), n in zip(self.found, times):
            out[ranges(begin, n)] = (crc % np.uint32(buckets)).astype(out.dtype)[number]
            begin += n
        return out, starts


def _stored(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words and the buckets of all features of each document, as bytes of little-endian numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            runs = Runs(part.column(1), longest)
            found, starts = runs.buckets(buckets)
            columns = [part.column(0), pa.array(runs.n_words, pa.int64()), binary_column(found, starts * found.dtype.itemsize)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, buckets binary")


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data, places = utf8(column)
    kind = _stored(buckets)
    return np.frombuffer(data.tobytes(), kind), places // kind.itemsize


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket, one row per task and bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "buckets"):
            total += np.bincount(_numbers(part.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = [(float(t + 1) * all_corpus) / (float(s + 1) * all_target) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio), np.int64, n)


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document, from the features of all of them."""
    rows = held(bucketed(docs, buckets, longest), "importance-buckets")
    wanted = target.select(F.lit(0).alias("doc_id"), "text")
    own = gains(bucket_counts(rows, buckets), bucket_counts(bucketed(wanted, buckets, longest), buckets))
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "buckets"):
            found, starts = _numbers(part.column(2), buckets)
            running = np.concatenate([[0], np.cumsum(sent.value[found])])
            numbers = [pa.array(x, pa.int64()) for x in (np.diff(starts), np.diff(running[starts]))]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *numbers], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) and n_words of every document."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0))).cast("long")
    rows = held(weighed(docs, target, buckets, longest).withColumn("score", F.col("weight") + gumbel), "importance")
    open_ = rows.where(F.col("n_words") >= min_words)
    order = {"_low": -F.col("score"), "_unnamed": F.col("doc_id").isNull(), "_id": F.col("doc_id"), "_row": F.monotonically_increasing_id()}
    placed = number_rows(open_.withColumns(order), list(order), "_rank", "_all")
    drawn = F.col("_rank") <= F.call_function("div", percent * F.col("_all"), F.lit(100))
    placed = placed.withColumn("rank", F.when(drawn, F.col("_rank")).cast("long"))
    short = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return placed.select(*columns).unionByName(short.select(*columns))
