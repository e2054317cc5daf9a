import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from circadia.llm import importance
from circadia.llm.text import slices


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets(text):
    return [zlib.crc32(r.encode()) % 10000 for r in runs(text)]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in docs:
        own = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    open_ = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = open_[: 5 * len(open_) // 100]
    return rows, drawn


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_runs(limit, odd_rows):
    texts = [t for _, t in odd_rows] + ["", "a", "A b", "É é ABC", "x\x00y z", "-", "a-b-c-a-b-c", "ß" * 70_000 + " ab", "\x7f", "9 9 9 9"]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    found, n_words = [], []
    for part in slices([batch], "text", limit):
        runs_ = importance.Runs(part.column(0))
        numbers, starts = runs_.buckets(10000)
        found += [numbers[a:b].tolist() for a, b in zip(starts, starts[1:])]
        n_words += runs_.n_words.tolist()
    assert n_words == [len(words(t)) for t in texts]
    assert found == [buckets(t) for t in texts]


def test_checksums_of_long_parts():
    rng = random.Random(1)
    left, right = (["".join(rng.choice("abcé") for _ in range(n)) for n in sizes] for sizes in ([1, 5, 900, 3], [70_000, 1, 4097, 12]))
    crc = lambda parts: np.array([zlib.crc32(p.encode()) for p in parts], np.uint32)
    joined = importance._zeros(crc(left), np.array([len(p.encode()) for p in right])) ^ crc(right)
    assert joined.tolist() == [zlib.crc32((a + b).encode()) for a, b in zip(left, right)]


def test_draw(spark, odd_rows, odd_docs):
    rng = random.Random(5)
    more = [(1000 + k, " ".join(rng.choice("alpha beta gamma delta 42 Ω").strip() + rng.choice("abc") for _ in range(rng.randint(15, 40)))) for k in range(300)]
    target = ["alphaa beta gamma", None, "", "αβγ ABC def", more[7][1]]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).withColumnsRenamed({"kept": "score", "bucket": "rank"})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    rows, drawn = brute([*odd_rows, *more], target)
    for parts in (3, 13):
        found = importance.resampled(docs.repartition(parts), bench).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in found) == Counter(map(tuple, rows))
        got = sorted((r["rank"], r.doc_id, r.score) for r in found if r["rank"] is not None)
        assert got == [(k, r[0], r[3]) for k, r in enumerate(drawn, start=1)]


def test_many_buckets(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (3, "b c")], "doc_id int, text string")
    found = {r.doc_id: list(memoryview(bytes(r.buckets)).cast("I")) for r in importance.bucketed(docs, 1 << 20, 2).collect()}
    crc = lambda *parts: [zlib.crc32(p.encode()) % (1 << 20) for p in parts]
    assert found == {1: crc("a", "b", "c", "a", "a b", "b c", "c a"), 2: [], 3: crc("b", "c", "b c")}
    assert importance.bucket_counts(importance.bucketed(docs, 1 << 20, 2), 1 << 20).sum() == 10


def test_ties_go_to_the_smaller_id(spark):
    # equal scores cannot be planted through the noise, so the order is tried on its own columns
    docs = spark.createDataFrame([(k % 5, "word " * 25) for k in range(100)], "doc_id long, text string")
    found = [r for r in importance.resampled(docs, docs.select("text")).collect() if r["rank"] is not None]
    best = max(found, key=lambda r: r.score)
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5] and {r.doc_id for r in found} == {best.doc_id}


def test_nothing(spark, no_docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.resampled(no_docs, empty).collect() == []
    one = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    found = {r.doc_id: r for r in importance.resampled(one, empty).collect()}
    assert found[1].weight == 0 and found[2].n_features == 3 and all(r["rank"] is None for r in found.values())
