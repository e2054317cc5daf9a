import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from circadia.llm import neighbours
from circadia.llm.text import mixed, slices


def hashed(raw, n):
    total = sum((b + 1) * int(neighbours._FACTORS[k % 1024]) for k, b in enumerate(raw)) % (1 << 64)
    return int(mixed(np.array([total], np.uint64))[0]) % n


def named(raw):
    return neighbours.LEXICAL + xxhash.xxh3_64_intdigest(raw) % neighbours.FORM


def brute(text):
    """Features and counts of a text, word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    out = Counter()
    kind = lambda b: b"0" if 48 <= b < 58 else b"A" if 65 <= b < 91 else b"a" if 97 <= b < 123 or b > 127 else bytes([b])
    for before, word in zip([None, *words], words):
        out[hashed(word.lower(), neighbours.LEXICAL)] += 1
        shape = b"".join(k for k, _ in groupby(kind(b) for b in word))
        out[neighbours.LEXICAL + hashed(shape, neighbours.FORM)] += 1
        if word == before:
            out[named(b"again")] += 1
    out[named(b"size %d" % math.ceil(math.log2(len(words) + 1)))] += 1
    seen, lines = set(), 0
    for line in raw.split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    if lines:
        out[named(b"line again")] += lines
    return out


ODD = ["", None, "a a a", "Aa1,, ÉÉ x", "z" * 1070 + "!!", "one\none\n\none", " \n "]


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_profiles(limit, odd_rows):
    texts = ODD + [t for _, t in odd_rows]
    got = []
    for part in slices([pa.record_batch([pa.array(texts, pa.string())], names=["text"])], "text", limit):
        found = neighbours.profiles(part.column(0))
        for a, b in zip(found.first, found.first[1:]):
            got.append(Counter(dict(zip(found.feature[a:b].tolist(), found.count[a:b].astype(int).tolist()))))
    assert got == [brute(t) for t in texts]


def _prose(rng, kind):
    words = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(15, 60))]
    if kind == 1:
        words = [w.upper() + "!!" for w in words]
    if kind == 2:
        words = [w for w in words[:6] for _ in range(8)]
    return " ".join(words)


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(9)
    rows = [(k, _prose(rng, k % 7 if k % 7 in (1, 2) else 0)) for k in range(700)]
    rows += [(1000, ""), (1001, None), (1002, "x"), (None, "Null id"), (None, None), (3, rows[3][1]), (1003, _prose(rng, 0) + " word" * 20_000)]
    labels = [(k, int(k % 7 not in (1, 2)), k % 2) for k in range(0, 700, 2)] + [(1000, 0, 0), (1004, 1, 1), (None, 1, 0), (8, None, 1), (9, 1, 0), (9, 0, 0)]
    docs = spark.createDataFrame([(i, t, "en", 0.5, "n") for i, t in rows], "doc_id long, text string, lang string, score double, label string")
    return rows, labels, docs, spark.createDataFrame([(*r, 0.0) for r in labels], "doc_id long, quality int, toxic int, score double")


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def test_every_cosine_counts(spark, taught):
    """Scores are those of all pairs of documents and labelled rows, one by one."""
    rows, labels, docs, table = taught
    space = neighbours.fitted(docs.repartition(3), table)
    known = {}
    for i, quality, _ in labels:
        if i is not None and quality is not None and fold(i) != 0:
            known.setdefault(i, []).append(quality)
    texts = dict(rows)
    ids = sorted(i for i in known if i in texts)
    assert space.labels.tolist() == [np.mean(known[i]) for i in ids]
    df = Counter(f for _, t in rows for f in brute(t))
    weight = {f: math.log((len(rows) + 1) / (n + 1)) + 1 for f, n in df.items()}

    def vector(text):
        out = np.zeros(neighbours.FEATURES)
        for f, n in brute(text).items():
            out[f] = math.sqrt(n) * weight[f]
        for half in (slice(0, neighbours.LEXICAL), slice(neighbours.LEXICAL, None)):
            out[half] /= np.linalg.norm(out[half]) or 1
        return out

    def unit(v):
        return v / np.linalg.norm(v)

    latent = np.stack([vector(texts[i]) for i in ids]) @ space.axes
    middle = latent.mean(0)
    places = [unit(v - middle) for v in latent]
    found = {r.doc_id: r for r in neighbours.scored(docs, table).collect()}
    for i, text in rows[::9] + rows[-7:]:
        if i is None:
            continue
        place = unit(vector(text) @ space.axes - middle)
        cosines = sorted(((round(float(place @ p), 5), y) for p, y in zip(places, space.labels)), reverse=True)
        nearest = [(max(c, 0) ** 2, y) for c, y in cosines if c >= cosines[neighbours.NEIGHBOURS - 1][0]]
        score = (sum(w * y for w, y in nearest) + 1e-3 * space.mean) / (sum(w for w, _ in nearest) + 1e-3)
        assert abs(found[i].score - score) < 2e-3
        assert found[i].held_out == (fold(i) == 0) and found[i].predicted == (found[i].score >= 0.3)


def test_axes_hold_what_a_full_decomposition_holds():
    rng = np.random.default_rng(2)
    matrix = (rng.standard_normal((60, 12)) * np.geomspace(9, 0.5, 12)) @ rng.standard_normal((12, 200))
    mine, full = neighbours._axes(matrix, 5), np.linalg.svd(matrix, full_matrices=False)[2][:5].T
    assert np.allclose(np.abs((mine * full).sum(0)), 1, atol=1e-3)


def test_held_out_rows_are_told(spark, taught):
    rows, _, docs, table = taught
    for parts in (2, 11):
        found = neighbours.scored(docs.repartition(parts), table).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 700]
        right = [r.predicted == (r.doc_id % 7 not in (1, 2)) for r in out]
        assert len(out) > 80 and sum(right) / len(right) > 0.97
        assert {r.score for r in found if r.doc_id == 3}.__len__() == 1
        assert all(r.held_out for r in found if r.doc_id is None)


def test_held_out_labels_are_not_read(spark, taught):
    rows, labels, docs, _ = taught
    turned = [(i, (1 - q if fold(i) == 0 and q is not None else q), t) for i, q, t in labels]
    scores = []
    for some in (labels, turned):
        table = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
        scores.append(sorted((r.doc_id or -1, r.score) for r in neighbours.scored(docs, table).collect()))
    assert scores[0] == scores[1]


def test_bounded_sample(spark, taught):
    _, _, docs, table = taught
    space = neighbours.fitted(docs, table, limit=50)
    assert len(space.labels) == 50 and space.vectors.shape == (50, 50)


def test_nothing(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert neighbours.scored(no_docs, labels).collect() == []
    found = neighbours.scored(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and {r.score for r in found} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in neighbours.scored(odd_docs, one).collect()} == {1}
