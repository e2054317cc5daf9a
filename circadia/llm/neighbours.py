"""Quality by its nearest labelled neighbours in a latent-semantic space.

A text is a vector of two halves of equal length: its words (lower-cased, hashed) and its form (the shapes of its
words, words that follow themselves, lines that return, how long it is). Square roots of counts are weighted by how
rare a feature is among *all* documents. A singular value decomposition of the labelled rows' vectors gives the
latent space; these rows' places in it, relative to their mean, are sent to all tasks, and every document meets all
of them: a block of documents times all labelled ones is one matrix product of exact cosines. The nearest ``NEIGHBOURS``
and all that are as near as the last of them vote with their label, weighted by the square of their similarity.

The labelled rows are a bounded sample: the ``LABELLED`` smallest by a checksum of the id. So what is sent (a few MB),
the decomposition on the driver and the cost of a document are the same at any number of documents. Everything else
covers all rows: document frequencies are summed per task first, and scores are one pass without a shuffle.
Labels, language, source and id are no inputs of a vector.

Defined results: null text is empty text, which has a form (no words) and so a vector; a null id is held out and no
neighbour; a label that comes more than once counts with its mean; without any label all scores are one half;
repeated rows get equal scores; a document without similarity to any neighbour gets the labels' mean. Scores
are rounded to four digits, beyond which the order of sums may show. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .quality import duplicate_lines
from .storage import picked
from .text import LOWER, WHITE, mixed, slices, word_hashes, words

#: Hashed features of the two halves.
LEXICAL, FORM = 4096, 512
FEATURES = LEXICAL + FORM
#: Most labelled rows that are learnt from.
LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
#: Smallest score that predicts label 1.
THRESHOLD = 0.3
#: Documents whose features are laid out at a time (a row has at most ``FEATURES`` of them), and in a block of cosines.
_LAID_OUT = 16
_BLOCK = 512
#: Weight of the labels' mean beside the votes.
_DOUBT = 1e-3

#: Letters, digits and bytes of other scripts are a class each, other marks are classes of their own.
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123], _CLASSES[128:] = 48, 65, 97, 97
#: Odd factors of the places of a word; they begin again in words that are longer.
_FACTORS = np.random.default_rng(7).integers(1 << 62, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _named(name: bytes) -> int:
    return LEXICAL + int(word_hashes(pa.array([name], pa.large_binary()))[0] % FORM)


def _hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings that begin at ``start`` and follow each other without gaps."""
    if not len(start):
        return np.empty(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    return mixed(np.add.reduceat((data + np.uint64(1)) * _FACTORS[place & (len(_FACTORS) - 1)], start))


@dataclass
class Profiles:
    """Counts of features, row after row: entries [first[i], first[i + 1]) are text i's."""

    feature: np.ndarray
    count: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def profiles(texts: pa.Array) -> Profiles:
    rows = len(texts)
    found = words(texts)
    packed = found.data[~WHITE[found.data]]
    start = np.cumsum(found.end - found.start) - (found.end - found.start)
    own = _hashes(packed, start)
    lexical = (_hashes(LOWER[packed], start) % np.uint64(LEXICAL)).astype(np.int64)
    # a word's shape is its classes of characters, runs of one class as one
    classes = _CLASSES[packed]
    turn = np.ones(len(packed), bool)
    turn[1:] = classes[1:] != classes[:-1]
    turn[start] = True
    form = LEXICAL + (_hashes(classes[turn], (np.cumsum(turn) - 1)[start]) % np.uint64(FORM)).astype(np.int64)
    text = found.text
    again = np.flatnonzero((own[1:] == own[:-1]) & (text[1:] == text[:-1])) + 1
    n_words = np.diff(found.first)
    lines = duplicate_lines(found)
    magnitude = np.array([_named(b"size %d" % k) for k in range(64)])
    every = np.arange(rows)
    row = np.concatenate([text, text, text[again], every, np.repeat(every, lines)])
    feature = np.concatenate([
        lexical, form, np.full(len(again), _named(b"again")),
        magnitude[np.ceil(np.log2(n_words + 1)).astype(np.int64)], np.full(int(lines.sum()), _named(b"line again")),
    ])
    key, count = np.unique(row * FEATURES + feature, return_counts=True)
    return Profiles(key % FEATURES, count, np.searchsorted(key, np.arange(rows + 1) * FEATURES))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, and the number of documents; a task sends one row per feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for part in slices(batches, "text"):
            found = profiles(part.column(0))
            total[:FEATURES] += np.bincount(found.feature, minlength=FEATURES)
            total[FEATURES] += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[sums.column("feature").to_numpy()] = sums.column("n").to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def fold(key: Column, folds: int = 5) -> Column:
    """Fold of an id by the checksum of its text; a null id is an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def learnt_from(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """text and label of at most ``limit`` labelled documents outside fold 0 (their ids' checksums are the smallest)."""
    known = picked(labels, doc_id="doc_id", label="quality").where("label is not null and doc_id is not null")
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.avg("label").alias("label"))
    rows = picked(docs, doc_id="doc_id", text="text")
    there = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows are sent; an id's rows are alike but for repeats, of which the first text is taken
    with_text = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return with_text.select("doc_id", F.col("text").cast("string").alias("text"), "label")


@dataclass
class Space:
    """What is sent to the tasks: weights of features, the latent space and the labelled rows in it."""

    weight: np.ndarray
    axes: np.ndarray
    middle: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float

    def values(self, found: Profiles) -> np.ndarray:
        """Weighted entries; each half of a row has length one, or zero if it is empty."""
        value = np.sqrt(found.count) * self.weight[found.feature]
        half = 2 * found.row + (found.feature >= LEXICAL)
        length = np.sqrt(np.bincount(half, weights=value**2, minlength=2 * (len(found.first) - 1)))
        return (value / length[half]).astype(np.float32)

    def placed(self, found: Profiles) -> np.ndarray:
        """Unit vectors in the latent space, relative to the labelled rows' middle."""
        value = self.values(found)
        # every text has a feature of its size, so no segment is empty
        latent = np.empty((len(found.first) - 1, self.axes.shape[1]), np.float32)
        for at in range(0, len(latent), _LAID_OUT):
            first = found.first[at : at + _LAID_OUT + 1]
            here = slice(first[0], first[-1])
            laid = self.axes[found.feature[here]] * value[here, None]
            latent[at : at + _LAID_OUT] = np.add.reduceat(laid, first[:-1] - first[0], axis=0)
        return _unit(latent - self.middle)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of a slice of texts."""
        if not len(self.labels):
            return np.full(len(texts), self.mean)
        places = self.placed(profiles(texts))
        return np.concatenate([np.empty(0), *[self.votes(places[at : at + _BLOCK]) for at in range(0, len(places), _BLOCK)]])

    def votes(self, places: np.ndarray) -> np.ndarray:
        cosines = np.round(places @ self.vectors.T, 5)
        behind = max(len(self.labels) - NEIGHBOURS, 0)
        last = np.partition(cosines, behind, axis=1)[:, behind]
        weight = np.where(cosines >= last[:, None], np.maximum(cosines, 0), 0).astype(np.float64) ** 2
        return np.round((weight @ self.labels + _DOUBT * self.mean) / (weight.sum(1) + _DOUBT), 4)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(length > 1e-6, length, np.inf)).astype(np.float32)


def _axes(matrix: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration, as columns."""
    start = np.random.default_rng(11).standard_normal((matrix.shape[1], min(dimensions + 16, *matrix.shape)))
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turned = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :dimensions]


def fitted(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, dimensions: int = DIMENSIONS) -> Space:
    """The latent space of the labelled rows under the document frequencies of all rows."""
    frequency, n = document_frequencies(docs)
    weight = np.log((n + 1) / (frequency + 1)) + 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = profiles(part.column(1))
            at = pa.array(found.first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((found.feature, pa.int32()), (found.count, pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, part.column(2)], names=["doc_id", "feature", "n", "label"])

    rows = learnt_from(docs, labels, limit)
    key = dict(rows.dtypes)["doc_id"]
    sample = rows.mapInArrow(described, f"doc_id {key}, feature array<int>, n array<double>, label double").toArrow().sort_by("doc_id")
    nothing = np.zeros((0, dimensions), np.float32)
    if not sample.num_rows:
        return Space(weight, np.zeros((FEATURES, dimensions), np.float32), nothing[:0], nothing, np.empty(0), 0.5)
    feature, count = (sample.column(c).combine_chunks() for c in ("feature", "n"))
    first = np.concatenate([[0], np.cumsum(feature.value_lengths().to_numpy())])
    found = Profiles(feature.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy(), first)
    label = sample.column("label").to_numpy()
    space = Space(weight, nothing, np.zeros(1, np.float32), nothing, label, float(label.mean()))
    matrix = np.zeros((sample.num_rows, FEATURES), np.float32)
    matrix[found.row, found.feature] = space.values(found)
    space.axes = _axes(matrix, dimensions).astype(np.float32)
    latent = matrix @ space.axes
    space.middle = latent.mean(0)
    space.vectors = _unit(latent - space.middle)
    return space


def scored(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out (its fold is 0), score and predicted of every document."""
    space = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, limit))
    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(space.value.scores(part.column(1)))], names=["doc_id", "score"])

    found = rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
