import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from circadia.llm import jaccard
from circadia.llm.components import components, local_roots

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Size, component and links of each row."""
    sets = [shingles(t) for _, t in rows]
    parent, links, holders = list(range(len(rows))), [0] * len(rows), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, shared in collections.Counter(j for x in s for j in holders[x]).items():
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        if doc_id is not None:
            smallest[root] = min(smallest.get(root, doc_id), doc_id)
    return [(d, len(sets[i]), d if not sets[i] else smallest.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)]


def changed(rng, words, share):
    return [rng.choice("pqrstuvw") * 3 if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family_rows(odd_rows):
    """Sets of many sizes around the threshold, chains, and families of copies."""
    rng, rows = random.Random(11), list(odd_rows)
    number = 1000
    for size in [*range(3, 40), 60, 90, 150, 400]:
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(size)]
        for share in (0, 0.01, 0.03, 0.05):
            rows.append((number, " ".join(changed(rng, base, share))))
            number += 1
        rows.append((number, " ".join(base[: max(1, int(size * 0.85))])))  # a part of it
        number += 1
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    for _ in range(60):
        rows.append((number, " ".join(changed(rng, base, 0.02))))
        number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 900])
def test_components_and_links(spark, family_rows, block):
    docs = spark.createDataFrame([(*r, 1, 2) for r in family_rows], "doc_id long, text string, k1 int, component int").repartition(5)
    got = [tuple(r) for r in jaccard.linked(docs, block).collect()]
    assert sorted(got, key=repr) == sorted(brute(family_rows), key=repr)


def test_one_of_each(odd_docs, odd_rows, no_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    left = collections.Counter((r.doc_id, shingles(r.text)) for r in kept.collect())
    want = {(d, c) for (d, n, c, _) in brute(odd_rows) if n and (d == c or c is None)}
    assert {d for d, s in left if s} == {d for d, _ in want}
    assert all(n == 1 for (_, s), n in left.items() if s)
    assert sum(n for (_, s), n in left.items() if not s) == sum(not shingles(t) for _, t in odd_rows)
    assert jaccard.one_of_each(no_docs).collect() == [] and jaccard.linked(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_signature(seed):
    """At the largest number of differences, with or without usable segments."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        a = int(rng.integers(4, 90))
        b = int(rng.integers(-(-4 * a // 5), a + 1))
        shared = -(-4 * (a + b) // 9)  # 5/4 of the union at most
        if shared > b:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, a + b + 9).astype(np.uint64))
        rng.shuffle(pool)
        big, small = np.sort(pool[:a]), np.sort(np.concatenate([pool[:shared], pool[a : a + b - shared]]))
        values, starts = np.concatenate([big, small]), np.array([0, len(big), len(big) + len(small)])
        weak = {s.band for s, _, _ in jaccard.banded(values, starts) if s.weak.any()}
        mine = [set(), set()]
        for sets, rows, own in jaccard.banded(values, starts):
            for sig, of in (sets.signatures()[:2], sets.prefixes() if sets.band in weak else (np.empty(0, np.uint64), np.empty(0, int))):
                for x, o in zip(sig.tolist(), of.tolist()):
                    mine[rows[o]].add(x)
        assert mine[0] & mine[1], (a, b, shared)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 500)]
    edges += [tuple(rng.sample(range(1000, 1200), 2)) for _ in range(150)]
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    at = {n: i for i, n in enumerate(nodes)}
    pairs = [(at[a], at[b]) for a, b in edges if a != b]
    root = local_roots(len(nodes), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    expected = {n: nodes[root[i]] for n, i in at.items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected and got[60] == 0 and got[179] == 100
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_by_rounds_and_in_one_task(spark, kind):
    """The same components, smallest node by Spark's order; few edges take a handful of jobs, whatever their depth."""
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(-40, 40)] + [tuple(rng.sample(range(1000, 1400), 2)) for _ in range(220)] + [(7, 7), (None, 3)]
    named = (lambda x: x) if kind == "long" else (lambda x: None if x is None else (x + 100).to_bytes(2, "little"))
    table = spark.createDataFrame([(named(a), named(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(5)
    by_rounds = {tuple(r) for r in components(table, task_edges=0).collect()}
    tracker, group = spark.sparkContext.statusTracker(), f"few-edges-{kind}"
    spark.sparkContext.setJobGroup(group, group)
    in_task = components(table).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in in_task} == by_rounds and len(in_task) == len(by_rounds)
    assert len(tracker.getJobIdsForGroup(group)) < 12
    assert components(table.where("false")).collect() == []


@pytest.mark.parametrize("held", [jaccard.LINKS_HELD, 1, 50])
def test_links_of_near_copies_are_not_all_held(monkeypatch, held):
    """A task's memory grows with its sets, not with their links: near copies all link to each other."""
    monkeypatch.setattr(jaccard, "LINKS_HELD", held)
    count = 1500 if held > 50 else 60
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 20).astype(np.uint64)
    own = rng.integers(0, 1 << 62, (count, 1)).astype(np.uint64)
    values = np.sort(np.concatenate([np.tile(common, (count, 1)), own], 1), 1).ravel()
    names, ones = np.arange(2 * count).reshape(count, 2), np.ones(count, np.int64)
    tracemalloc.start()
    root, links = jaccard._linked(names, 2 * ones, ones, values, np.arange(count + 1) * 21)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not root.any() and (links == count - 1).all()
    assert peak < 40 << 20
    # two sides: links inside a side are other tasks' work
    side = np.arange(count) % 2
    root, links = jaccard._linked(names, side, ones, values, np.arange(count + 1) * 21)
    assert not root.any() and (links == np.where(side == 0, count // 2, count - count // 2)).all()


def test_sets_of_texts(odd_rows):
    texts = [t for _, t in odd_rows]
    values, starts = jaccard.shingle_sets(pa.array(texts))
    assert np.diff(starts).tolist() == [len(shingles(t)) for t in texts]
    one, two = jaccard.keys(values, starts)
    same = collections.defaultdict(set)
    for t, a, b in zip(texts, one, two):
        same[shingles(t)].add((a, b))
    assert all(len(k) == 1 for k in same.values()) and len({next(iter(k)) for k in same.values()}) == len(same)
