import itertools
import re
from collections import Counter

import pytest

from circadia.llm import audit


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
        "E": copy,
    }
    return {name for name, failed in tests.items() if failed}


def brute(docs, labels):
    """Every order by itself, document by document."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows, shapley = [], Counter()
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    known = [(i, lang or "", fails(text or "", i is not None and i > smallest[text or ""])) for i, text, lang in docs]
    for part in {lang for _, lang, _ in known}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, lang, f in known if lang == part]
            gone = []
            for step, name in enumerate(order, start=1):
                out = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                redundant = sum(name in f for _, f in gone)
                gone += out
                only = sum(f == {name} for _, lang, f in known if lang == part)
                rows.append([part, "".join(order), step, len(left), len(out), redundant, only, sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)])
                shapley[part, name] += len(out)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


@pytest.fixture(scope="module")
def audited():
    long = " ".join(f"w{k}" for k in range(230))
    texts = [
        long, long + " #", long.upper(), "a b c", "SHOUT " * 300, "x " * 250, None, "", " \n\t\x0b\x0c\r ", "Äé$" * 90, long, "a b c", long + " #",
        "\x1c".join("ab" for _ in range(400)), "a b " * 220, "C" + "c" * 40, "CC" + "c" * 40, "🙂 " * 199, "é" * 50_000,
    ]
    docs = [(10 * k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)]
    docs += [(5, long, "en"), (None, long, "en"), (None, "", None), (30, "a b c", "en"), (30, "a b c", "de"), (40, texts[4], "fr"), (41, texts[4], "fr")]
    docs += [(1000 + k, "copy me " * 120 if k % 3 else long + f" {k}", "en") for k in range(90)]
    labels = [(10, 1, 0), (10, 0, 1), (30, 1, None), (0, 1, 1), (1002, 1, 1), (1003, None, None), (None, 1, 1), (99_999, 1, 1), (10, 1, 0), (40, 1, 0), (41, 0, 1)]
    return docs, labels


def _frames(spark, docs, labels):
    # other columns of the same names as the operator's own take no part
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, lang string, key long, part string").repartition(5)
    return frame, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, bit int")


def test_equals_every_order_on_its_own(spark, audited):
    found = audit.interactions(*_frames(spark, *audited))
    assert sorted(tuple(r) for r in found.collect()) == brute(*audited)


def test_identities(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.interactions(odd_docs, labels).collect()
    parts = Counter(r.lang or "" for r in odd_docs.select("lang").collect())
    assert len(rows) == 600 * len(parts)
    last = {}
    for r in sorted(rows):
        before = last.get((r.part, r.filter_order), parts[r.part])
        assert r.kept == before - r.removed
        assert (r.good_lost, r.toxic_lost) == (0, 0)
        last[r.part, r.filter_order] = r.kept
    # what all orders remove in total is what fails anything, once per order
    for part in parts:
        assert sum(r.shapley for r in rows if r.part == part and r.filter_order == "ABCDE") == 120 * (parts[part] - last[part, "ABCDE"])


def test_other_filters_and_no_copies(spark, audited):
    docs, labels = _frames(spark, *audited)
    found = audit.interactions(docs, labels, {"long": "length(text) > 100", "few": "n_distinct < 3"}, None).collect()
    assert {r.filter_order for r in found} == {"longfew", "fewlong"}
    english = [t or "" for _, t, lang in audited[0] if lang == "en"]
    first = next(r for r in found if r.part == "en" and r.filter_order == "longfew" and r.step == 1)
    assert first.removed == sum(len(t) > 100 for t in english)


def test_no_documents(spark, no_docs):
    assert audit.interactions(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
