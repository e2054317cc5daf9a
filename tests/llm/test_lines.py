import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from circadia.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def distance(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


def points(texts):
    return np.concatenate([np.array(list(map(ord, t)), np.uint32) for t in texts]), np.cumsum([0, *map(len, texts)])


def edited(rng, text, edits, shortest, letters):
    chars = list(text)
    for _ in range(edits):
        p, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.35:
            chars.insert(p, rng.choice(letters))
        elif kind < 0.65 and len(chars) > shortest:
            del chars[p]
        else:
            chars[p] = rng.choice(letters)
    return "".join(chars)


@pytest.mark.parametrize("seed", range(40))
def test_distances_signatures_and_classes(seed):
    rng = random.Random(seed)
    edits = rng.choice([1, 2, 3])
    shortest = edits + 1 + rng.randint(0, 3)
    made = {"".join(rng.choice("abé🙂") for _ in range(rng.randint(shortest + 3, 30))) for _ in range(4)}
    for _ in range(25):
        made.add(edited(rng, rng.choice(sorted(made)), rng.randint(0, 3), shortest, "abé"))
    made = sorted(t for t in made if len(t) >= shortest)
    flat, starts = points(made)
    a, b = np.triu_indices(len(made), 1)
    near = np.array([distance(made[i], made[j]) <= edits for i, j in zip(a, b)])
    assert np.array_equal(lines.within(flat, starts, a, b, edits), near)
    sig, owner = lines.signatures(flat, starts, edits, shortest)
    by = collections.defaultdict(set)
    for s, o in zip(sig.tolist(), owner.tolist()):
        by[o].add(s)
    assert all(by[i] & by[j] for i, j, n in zip(a, b, near) if n)
    # the same line has the same signatures whatever else is in its slice
    alone, _ = lines.signatures(*points(made[:1]), edits, shortest)
    assert set(alone.tolist()) == by[0]
    assert np.array_equal(lines.classes_in(flat, starts, edits, shortest), roots(len(made), a[near], b[near]))


def roots(count, a, b):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(a, b):
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(count)]


def brute(rows):
    """What is left of each (doc_id, text), and its number of lines and lines in near classes."""
    identities = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in rows})
    found = [(d, n, line.strip(WHITE)) for d in identities for n, line in enumerate(d[3].split("\n")) if len(line.strip(WHITE)) >= lines.MIN_LENGTH]
    distinct = sorted({c for *_, c in found}, key=lambda c: (len(c), c))
    flat, starts = points(distinct) if distinct else (np.empty(0, np.uint32), np.zeros(1, int))
    a, b = np.triu_indices(len(distinct), 1)
    size = np.diff(starts)
    close = np.abs(size[a] - size[b]) <= lines.EDITS
    a, b = a[close], b[close]
    near = lines.within(flat, starts, a, b)
    root = dict(zip(distinct, roots(len(distinct), a[near], b[near])))
    linked = {distinct[i] for i in [*a[near], *b[near]]}
    head, gone, n_lines, n_near = {}, collections.defaultdict(set), collections.Counter(), collections.Counter()
    for d, n, c in found:
        n_lines[d] += 1
        n_near[d] += c in linked
        if head.setdefault(root[c], (d, n)) != (d, n):
            gone[d].add(n)
    return {(None if d[0] else d[1], d[3]): (n_lines[d], n_near[d], len(gone[d]), "\n".join(x for n, x in enumerate(d[3].split("\n")) if n not in gone[d])) for d in identities}


@pytest.fixture(scope="module")
def line_rows(odd_rows):
    rng, rows = random.Random(4), list(odd_rows)
    letters = "abcdefghij "
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(15, 60))) for _ in range(40)]
    pool += [f"Page {i} of 40 of this very common report" for i in range(1, 41)]
    for i in range(60):
        chosen = [edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 4]), 10, letters) for _ in range(rng.randint(0, 8))]
        rows.append((2000 + i, "\n".join(rng.choice(["", "  ", "\t"]) + c + rng.choice(["", " ", "\r"]) for c in chosen)))
    return rows


@pytest.mark.parametrize("block", [lines.BLOCK_CHARS, 400])
def test_documents(spark, line_rows, block, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 5) for r in line_rows], "doc_id long, text string, row string, n_lines int").repartition(4)
    monkeypatch.setattr(lines.near_classes, "__defaults__", (lines.EDITS, lines.MIN_LENGTH, block))
    expected = brute(line_rows)
    assert sum(v[1] for v in expected.values()) > 40
    rows = lines.deduplicated(docs).collect()
    assert len(rows) == len(line_rows)
    for r in rows:
        text = r["row"]["text"]
        want = expected[r["row"]["doc_id"], text or ""]
        assert (r["n_lines"], r["n_near"], r["n_removed"], r["kept_text"]) == (*want[:3], want[3] if text is not None else None)


def test_filtered_keeps_columns(odd_docs, odd_rows, no_docs):
    kept = lines.filtered(odd_docs)
    assert kept.columns == odd_docs.columns
    expected = brute(odd_rows)
    want = []
    for i, t in odd_rows:
        new = expected[i, t or ""]
        if new[2] == 0 or new[3].strip(WHITE):
            want.append((i, None if t is None else new[3], len(new[3]) if new[2] else len(t or "")))
    got = [(r.doc_id, r.text, r.n_chars) for r in kept.select("doc_id", "text", "n_chars").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lines.filtered(no_docs).collect() == []


def budget(a, b):
    return min(lines.EDITS, min(len(a), len(b)) * lines.EDITS // lines.MIN_LENGTH)


@pytest.mark.parametrize("seed", range(6))
def test_graded_signatures_and_classes(seed):
    rng = random.Random(seed)
    made = {"".join(rng.choice("abé🙂") for _ in range(rng.randint(1, 30))) for _ in range(8)}
    for _ in range(60):
        made.add(edited(rng, rng.choice(sorted(made)), rng.randint(0, 3), 1, "abé"))
    made = sorted(made)
    flat, starts = points(made)
    a, b = np.triu_indices(len(made), 1)
    near = np.array([distance(made[i], made[j]) <= budget(made[i], made[j]) for i, j in zip(a, b)])
    assert near.any()
    assert np.array_equal(lines.classes_in(flat, starts, graded=True), roots(len(made), a[near], b[near]))
    sig, owner = lines.signatures(flat, starts, graded=True)
    by = collections.defaultdict(set)
    for s, o in zip(sig.tolist(), owner.tolist()):
        by[o].add(s)
    assert all(by[i] & by[j] for i, j, n in zip(a, b, near) if n)


def test_every_line_with_a_word_takes_part(spark):
    texts = ["Les.\nOf, edti oner.\nThe first line that is long enough", "x\n\n  Les. \nOf, edit oner.\nLes", "}\nx\nOf, edti omer.", "}\nThe first lime that is long enough", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_near"], r["n_removed"], r["kept_text"]) for r in lines.deduplicated(docs, graded=True).collect()}
    assert got == {
        0: (3, 2, 0, texts[0]), 1: (4, 0, 1, "x\n\nOf, edit oner.\nLes"), 2: (3, 1, 2, "}"),
        3: (2, 1, 2, ""), 4: (0, 0, 0, " \n"),
    }


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("held", [lines.VARIANTS, 200])
def test_lines_two_edits_apart_have_a_variant_in_common(seed, held, monkeypatch):
    monkeypatch.setattr(lines, "VARIANTS", held)
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "abé🙂"])
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 25))) for _ in range(4)}
    for _ in range(40):
        made.add(edited(rng, rng.choice(sorted(made)), rng.randint(0, 4), 1, letters))
    made |= {"bbab" + letters, "bbabab" + letters, "a", "aaa", "aaaaa"}
    made = sorted(made)
    rng.shuffle(made)
    by = collections.defaultdict(set)
    for value, owner, _ in lines.variants(*points(made), np.zeros(len(made), np.int64)):
        for v, o in zip(value.tolist(), owner.tolist()):
            by[o].add(v)
    pairs = [(i, j) for i in range(len(made)) for j in range(i) if distance(made[i], made[j]) <= 2]
    assert len(pairs) > 20
    assert all(by[i] & by[j] for i, j in pairs)


def test_copies_with_changed_words_are_not_all_compared(monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    base = [word() for _ in range(40)]
    made = {" ".join(base)}
    while len(made) < 600:
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(words))
            words[k] = word() if rng.random() < 0.8 else words[k] + rng.choice("xyz")
        made.add(" ".join(words))
    made = sorted(made)
    rng.shuffle(made)
    flat, starts = points(made)
    a, b = np.triu_indices(len(made), 1)
    size = np.diff(starts)
    a, b = a[np.abs(size[a] - size[b]) <= 2], b[np.abs(size[a] - size[b]) <= 2]
    near = lines.within(flat, starts, a, b)
    assert near.sum() > 20
    decided = []
    whole = lines.within
    monkeypatch.setattr(lines, "within", lambda points, starts, a, b, edits: decided.append(len(a)) or whole(points, starts, a, b, edits))
    assert np.array_equal(lines.classes_in(flat, starts, graded=True), roots(len(made), a[near], b[near]))
    # every one of them shares a segment with hundreds
    assert sum(decided) < 5 * len(made)


def test_ends_and_lengths_of_lines():
    texts = ["a" + " " * 40 + "\n" + "\t " * 20 + "é 日🙂 b" + "\r" * 20, None, " " * 50 + "\n\n" + " " * 9 + "x", "", "\n" * 3, "y"]
    found = lines.Lines(pa.array(texts, pa.string()), 1)
    want = [(t, n, line.strip(WHITE)) for t, text in enumerate(texts) for n, line in enumerate((text or "").split("\n")) if line.strip(WHITE)]
    flat, starts = found.code_points(np.arange(len(want)))
    got = ["".join(map(chr, flat[a:b])) for a, b in zip(starts, starts[1:])]
    assert list(zip(found.text.tolist(), found.number.tolist(), got)) == want
    assert found.length.tolist() == [len(w[2]) for w in want]


def test_a_line_has_the_same_signatures_behind_many_code_points():
    rng = random.Random(3)
    made = ["".join(rng.choice("abé🙂") for _ in range(n)) for n in (70_000, 31, 60_000, 25, 150_000)]
    flat, starts = points(made)
    sig, owner = lines.signatures(flat, starts, graded=True)
    for i, line in enumerate(made):
        alone, _ = lines.signatures(*points([line]), graded=True)
        assert sorted(sig[owner == i].tolist()) == sorted(alone.tolist())
