import random

import pytest

from circadia.llm import decontam


def column(p, t):
    """Distances of p to the best stretch that ends at each place of t."""
    previous = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        current = [i]
        for j, y in enumerate(t, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous


def distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        p, kind = rng.randrange(len(chars) + 1), rng.random()
        if kind < 0.3:
            chars.insert(p, "z")
        elif kind < 0.6 and p < len(chars):
            del chars[p]
        elif p < len(chars):
            chars[p] = "y"
    return "".join(chars)


@pytest.mark.parametrize("seed", range(80))
def test_matches_equal_the_distance_table(seed):
    rng = random.Random(seed)
    items = [(i, decontam.normal("".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))) or "a") for i in range(4)]
    text = decontam.normal("".join("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 20))) + edited(rng, rng.choice(items)[1], rng.randint(0, 5)) for _ in range(3)))
    found = {item.item_id: rest for item, *rest in decontam.Matcher(items, 0.2).matches(text)}
    for i, p in items:
        best = min(column(p, text)[1:], default=99)
        if text and best <= int(0.2 * len(p)):
            d, start, length = found[i]
            assert d == best == distance(p, text[start : start + length])
        else:
            assert i not in found


def test_documents(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    rng = random.Random(1)
    long = [t for _, t in odd_rows if t and len(t) > 300]
    items = [(1, long[0][40:240]), (2, edited(rng, long[1][20:260].lower(), 6)), (3, "no such item anywhere in these documents"), (4, None), (5, ""), (6, " .. "), (7, long[0][40:240].upper()),
             (None, long[2][10:150])]
    benchmark = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    expected, held = [], set()
    for doc_id, text in odd_rows:
        for item_id, item in items:
            p, t = decontam.normal(item), decontam.normal(text)
            if p and t and len(t) < 20_000:
                best = min(column(p, t)[1:])
                if best <= int(decontam.ERROR_RATE * len(p)):
                    expected.append((doc_id, item_id, best))
                    held.add((doc_id, text))
    assert len({e[1] for e in expected}) == 4
    for block in (decontam.BLOCK_CHARS, 150):  # in one block and in several
        monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
        got = [(r.doc_id, r.item_id, r.distance) for r in decontam.matches(odd_docs, benchmark).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
        kept = decontam.clean(odd_docs, benchmark)
        assert kept.columns == odd_docs.columns
        left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        assert sorted(left, key=repr) == sorted([r for r in odd_rows if r not in held], key=repr)
    assert decontam.matches(no_docs, benchmark).collect() == []
    assert decontam.matches(odd_docs, benchmark.where("false")).collect() == []
