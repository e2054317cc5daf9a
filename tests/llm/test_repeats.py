import collections
import hashlib
import random

import numpy as np
import pytest

from circadia.llm import repeats

LENGTH = repeats.LENGTH


def brute(rows, keep):
    """Bytes, removed bytes, runs and digest of each row, by all strings of all rows."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    places = collections.defaultdict(list)
    for k in order:
        raw = (rows[k][1] or "").encode()
        for i in range(len(raw) - LENGTH + 1):
            places[raw[i : i + LENGTH]].append((k, i))
    hit = collections.defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for k, i in found if keep == "none" else found[1:]:
                hit[k].append(i)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        gone = np.zeros(len(raw) + 2, bool)
        for i in hit[k]:
            gone[1 + i : 1 + i + LENGTH] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone[1:-1]].tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcdef \n") for _ in range(rng.randint(150, 900))) for _ in range(10)]
    rows = []
    for i in range(45):
        parts = [rng.choice([rng.choice(pool), rng.choice(pool)[50:350], "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300))), "a" * rng.choice([0, 10, 260, 500])]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    return rows + [(60, None), (61, ""), (62, "x" * 200), (63, "y" * 201), (64, "z" * 199), (65, "é" * 150)]


def collected(df):
    return sorted(
        (r["row"]["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in df.collect()
    )


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("many", [repeats.MANY, 1])
def test_against_all_strings(spark, passages, keep, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    docs = spark.createDataFrame([(*r, "x", 5) for r in passages], "doc_id long, text string, begin string, spans int").repartition(5)
    assert collected(repeats.removed(docs, keep)) == sorted(brute(passages, keep))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = [(r["row"]["doc_id"], r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.removed(odd_docs).collect()]
    expected = [(e[0], e[1], e[4]) for e in brute(odd_rows, "none")]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert repeats.removed(no_docs).collect() == []
    with pytest.raises(ValueError):
        repeats.spans(odd_docs, keep="last")


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnop"])
def test_suffix_ranks(letters):
    rng = random.Random(2)
    raw = "".join(rng.choice(letters) for _ in range(900)).encode()
    raw = raw + raw[100:600]
    starts = np.arange(len(raw) - LENGTH + 1)
    rank = repeats.suffix_ranks(np.frombuffer(raw, np.uint8), starts)
    strings = [raw[i : i + LENGTH] for i in starts]
    assert [sorted(set(strings)).index(s) for s in strings] == rank.tolist()
    earlier, later = repeats.previous_and_next(rank, starts)
    assert earlier.tolist() == [strings.index(s) < i for i, s in enumerate(strings)]
    assert later.tolist() == [s in strings[i + 1 :] for i, s in enumerate(strings)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_copies_send_one_region_of_each_content(spark, keep, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(i, passage) for i in range(200)] + [(200, "#" + passage[1:]), (201, passage[:300] + "#" + passage[301:])]
    suffix_spans = repeats._suffix_spans

    def watched(keep):
        inner = suffix_spans(keep)

        def spans(table):
            assert table.num_rows <= 60
            return inner(table)

        return spans

    monkeypatch.setattr(repeats, "_suffix_spans", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(repeats.removed(docs, keep)) == sorted(brute(rows, keep))
