import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from circadia.llm import quality
from circadia.llm.text import slices

ODD = ["", None, " ", "\n", "a", "a\na", "a\n\na\n a\nb\nb", "é é é é é é é é é é", "x y z w v x y z w v", "|#é\x0b\x0c\r\n", "a\n", "\na\na", "a " * 30]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_counts(limit, odd_rows):
    texts = ODD + [t for _, t in odd_rows]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    found = [quality.counts(part.column(0)) for part in slices([batch], "text", limit)]
    got = list(zip(*[np.concatenate([f[name] for f in found]).tolist() for name in quality.COUNTS]))
    assert got == [brute(t) for t in texts]


def mcd(x):
    """Concentration steps on rows in memory, by the same rules."""

    def solved(rows, whole):
        mean = rows.mean(0)
        cov = (rows.T @ rows) / len(rows) - np.outer(mean, mean)
        q = quality.chi_square_quantile(quality.COVERAGE, quality.DIMENSIONS)
        cov = cov * (1.0 if whole else quality.COVERAGE / quality.chi_square(q, quality.DIMENSIONS + 2))
        cov = cov + np.diag([floor**2 for _, floor in quality.VECTOR])
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    low, mid, high = np.percentile(x, [25, 50, 75], axis=0)
    wide = np.diag(((high - low) / 1.349) ** 2 + [floor**2 for _, floor in quality.VECTOR])
    best = None
    for mean, precision in ((mid, np.linalg.inv(wide)), solved(x, True)[:2]):
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
            far = np.floor(8 * np.log2(d + 2.0**-20))
            nearest = np.sort(far)[int(np.ceil(quality.COVERAGE * len(x))) - 1]
            mean, precision, log_det = solved(x[far <= nearest], False)
        if best is None or log_det < best[2] - 1e-9:
            best = mean, precision, log_det
    d = np.einsum("ij,jk,ik->i", x - best[0], best[1], x - best[0])
    return d <= quality.chi_square_quantile(1 - quality.TAIL, quality.DIMENSIONS)


def test_verdicts_equal_estimates_in_memory(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnop"
    rows = []
    for i in range(240):
        long_words = i % 40 == 0
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(14, 20) if long_words else rng.randint(2, 8))) for _ in range(rng.randint(12, 90))]
        if i % 31 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "big"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in quality.judged(docs, ["doc_id"]).collect()}
    import math

    x = []
    for _, text, _, _ in rows:
        n, chars, symbols, again, repeat = brute(text)
        v = [math.log2((chars + 100) / (n + 20)), math.log2(1 + 100 * symbols / n), math.log2(1 + again), math.sqrt(repeat / n)]
        x.append([round(value * quality.UNIT) / quality.UNIT for value in v])
    expected = mcd(np.array(x))
    assert [got[i]["kept"] for i in range(240)] == expected.tolist()
    assert not any(got[i]["kept"] for i in range(0, 240, 31)) and sum(expected) > 220


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = quality.judged(odd_docs, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows)
    expected = collections.Counter((i, *brute(t)) for i, t in odd_rows)
    assert collections.Counter((r["row"]["doc_id"], *[r[c] for c in quality.COUNTS]) for r in rows) == expected
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judged(no_docs, ["doc_id"]).collect() == []
    kept = quality.filtered(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 4) - 9.4877) < 1e-3
    assert abs(quality.chi_square(5.3853, 4) - 0.75) < 1e-4


def test_a_large_group_of_copies_does_not_move_the_estimate(spark):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) for _ in range(200)]
    junk = "\n".join(f"a{k} ##### b{k} ||||| c{k} <<<<< d{k}\nagain" for k in range(14))
    copies = 86  # three tenths of all rows
    rows = [(i, t, "en", "big") for i, t in enumerate(good + [junk] * copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] for i in range(200, 200 + copies))
    assert all(got[i]["kept"] for i in range(200))


def test_rounds_end_with_their_smallest_determinant(spark, monkeypatch):
    from pyspark.sql import functions as F

    def alternating(rows, estimate):
        turned = F.array(*[(F.col("mean")[0] + 1) % 3] * quality.DIMENSIONS)
        moved = estimate.withColumn("mean", turned).withColumn("rows", F.lit(7).cast("long"))
        return moved.withColumn("log_det", F.abs(F.col("mean")[0] - 1)).select("part", "start", "rows", "mean", "precision", "log_det")

    monkeypatch.setattr(quality, "_concentrated", alternating)
    rows = spark.range(9).select(F.lit("p").alias("part"), *[(F.lit(quality.UNIT)).cast("long").alias(f"x{i}") for i in range(quality.DIMENSIONS)])
    assert [r.mean[0] for r in quality.estimates(rows).collect()] == [1.0]
    with pytest.raises(RuntimeError):
        quality.estimates(rows, max_steps=2)


def test_small_parts_take_their_steps_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(part, *[round(rng.gauss(0, 1 + i) * quality.UNIT) for i in range(quality.DIMENSIONS)], rng.randint(1, 4)) for part, n in (("a", 300), ("b", 80)) for _ in range(n)]
    vectors = spark.createDataFrame(rows, "part string, " + ", ".join(f"x{i} long" for i in range(quality.DIMENSIONS)) + ", times long").repartition(3)
    numbers = lambda df: {r["part"]: (r["rows"], np.round(r["mean"] + r["precision"], 9).tolist()) for r in df.collect()}
    by_jobs = numbers(quality.estimates(vectors))
    assert numbers(quality.estimates(vectors, task_vectors=100)) == by_jobs
    stepped = []
    monkeypatch.setattr(quality, "_concentrated", lambda *a: stepped.append(a))
    assert numbers(quality.estimates(vectors, task_vectors=300)) == by_jobs
    with pytest.raises(RuntimeError):
        quality.estimates(vectors, max_steps=1, task_vectors=300)
    # the query and the pipeline take this way: not a job per step
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 12 + id % 30), i -> concat('w', i * (id % 50 + 1))), ' ')").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert quality.judged(docs, ["doc_id"]).count() == 400 and not stepped
