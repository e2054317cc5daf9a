import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from circadia.llm import lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_sequences():
    rng = np.random.default_rng(1)
    for values in (np.array([], np.int64), np.array([0]), np.array([7, 7, 7, 9]), np.sort(rng.integers(0, 5000, 900)), np.sort(rng.integers(0, 1 << 40, 300)), np.arange(500)):
        raw = np.frombuffer(lm.EliasFano.pack(values) + b"\x00" * 9, np.uint8)
        made, _ = lm.EliasFano.load(raw, 0)
        assert made.size == len(values)
        if len(values):
            assert np.array_equal(made.get(np.arange(len(values))), values)
            asked = np.concatenate([values, values + 1, rng.integers(0, int(values[-1]) + 50, 200)])
            assert np.array_equal(made.successor(asked), np.searchsorted(values, asked))


def test_compact():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 24, 100_000))
    assert len(lm.EliasFano.pack(values)) < 100_000 * 10.5 / 8


def test_trie_finds_every_pair():
    rng = np.random.default_rng(4)
    first, second = rng.integers(1, 1 << 63, 60).astype(np.uint64), rng.integers(1, 1 << 63, 90).astype(np.uint64)
    pairs = sorted({(int(rng.choice(first[:50])), int(rng.choice(second[:80]))) for _ in range(700)})
    a, b = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)
    count = rng.integers(1, 9, len(pairs)).astype(float)
    trie, file = lm.mapped(lm.build(a, b, count, {}))
    asked = [(int(x), int(y)) for x in first for y in second]
    log_p, seen, back = trie.find(np.array([x for x, _ in asked], np.uint64), np.array([y for _, y in asked], np.uint64))
    known = dict(zip(pairs, count))
    totals, kinds = collections.Counter(), collections.Counter()
    for (x, _), c in known.items():
        totals[x] += c
        kinds[x] += 1
    for k, (x, y) in enumerate(asked):
        assert seen[k] == ((x, y) in known)
        want = math.log10((known[x, y] - lm.DISCOUNT) / totals[x]) if (x, y) in known else math.log10(lm.DISCOUNT * kinds[x] / totals[x]) if totals[x] else 0
        assert abs(log_p[k] + back[k] - want) <= 0.5 / lm.STEP + 1e-9
    file.close()


def brute(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    words, pairs, heads, kinds = (collections.Counter() for _ in range(4))
    for w, o in zip(tokens, out):
        if not o:
            words.update(w)
            for x, y in zip(["<"] + w[:-1], w):
                kinds[x] += (x, y) not in pairs
                pairs[x, y] += 1
                heads[x] += 1
    n, v = sum(words.values()), len(words)

    def log_p(x, y):
        one = math.log10((words[y] + 1) / (n + v + 1))
        if (x, y) in pairs:
            return math.log10((pairs[x, y] - lm.DISCOUNT) / heads[x])
        return one + (math.log10(lm.DISCOUNT * kinds[x] / heads[x]) if heads[x] else 0)

    return [(i, o, len(w), sum(words[y] > 0 for y in w), n, sum(math.log10((words[y] + 1) / (n + v + 1)) for y in w), sum(log_p(x, y) for x, y in zip(["<"] + w[:-1], w)))
            for (i, _), o, w in zip(rows, out, tokens)]


def compare(got, expected):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    assert len(got) == len(expected)
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert tuple(g)[:5] == e[:5]
        assert abs(g[5] - e[5]) < 1e-6 * max(1, abs(e[5]))
        assert abs(g[6] - e[6]) <= e[2] / lm.STEP + 1e-6


@pytest.mark.parametrize("split", [0.0001, 4, 1000])  # no word is split over the shards, the usual, all are
def test_scores(odd_docs, odd_rows, split, monkeypatch):
    monkeypatch.setattr(lm, "SPLIT", split)
    monkeypatch.setattr(lm, "SLICE", 3000)
    compare(lm.scored(odd_docs, lm.seventh()).collect(), brute(odd_rows))


def test_nothing_to_learn_from(odd_docs, no_docs):
    rows = lm.scored(odd_docs.where("doc_id < 9"), F.lit(True)).collect()
    assert rows and all(r.score == r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)
    assert lm.scored(no_docs, lm.seventh()).collect() == []


def test_held_out_texts_are_predicted_better(spark):
    folder = "/root/testdata/sf0.01"
    rows = lm.scored(spark.read.parquet(f"{folder}/documents.parquet"), lm.seventh()).where("held_out")
    model, base = rows.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert model > base + 0.3


def test_messages_to_many_shards_stay_small():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 5000) for _ in range(2000)]
    cut, out = lm.Slice(pa.array(texts)), np.sort(rng.random(2000) < 1 / 7)
    numbers = np.arange(500)
    sent = {
        "words": sum(len(m[3]) for m in lm._word_messages(numbers)(cut, out, 0)),
        "pairs": sum(len(m[3]) for m in lm._pair_messages(numbers, np.empty(0, np.uint64))(cut, out, 0)),
    }
    # 329,492 and 618,247 with the held-out flag of every text in every message and hashes as they are
    assert sent["words"] < 200_000 and sent["pairs"] < 500_000


def test_sums_come_back_small_and_true():
    rng = np.random.default_rng(6)
    text, value = rng.integers(0, 2000, 9000), rng.normal(-3, 4, 9000)
    _, _, _, raw = lm._sums(1, "base", text, value, np.ones(9000))
    touched, fixed, times = lm._unpress(raw)
    assert np.array_equal(touched, np.unique(text)) and times.sum() == 9000
    assert np.abs(lm._real(fixed) - np.bincount(text, value, 2000)[touched]).max() < 1e-9
    # 16,620 bytes as doubles
    assert len(raw) < 13_000
