import random

import pytest
from pyspark.sql import functions as F

PROSE = "the of and to in that was his he it with is for as had you not be her on at by which".split()


def prose(rng: random.Random, words: int) -> str:
    made = [rng.choice(PROSE) if rng.random() < 0.4 else "".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(words)]
    out = []
    while made:
        n = rng.randint(6, 18)
        out.append(" ".join(made[:n]).capitalize() + ".")
        made = made[n:]
    return "\n".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, blank and repeated texts, exact and near copies, one long text."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:12]):
        words = t.split(" ")
        for k in rng.sample(range(len(words)), min(len(words), 1 + i // 4)):
            words[k] = "changed"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, t))
    rows += [(None, texts[3]), (None, None), (None, ""), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"),
             (305, "Two words"), (306, "two WORDS"), (307, "é" * 300 + " ñandú 日本語 🙂"), (308, prose(rng, 6000)), (5, texts[5]), (5, texts[5])]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a documents table over several partitions, with columns that operators use themselves."""
    langs = ["en", "de", None]
    made = [(i, t, langs[k % 3], f"src{k % 2}" if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(odd_rows)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["piece", "length", "row", "key", "bucket", "n_words", "kept", "component", "_row", "sequence_id"]
    return df.withColumns({c: F.lit(c) for c in clashes}).repartition(4)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
