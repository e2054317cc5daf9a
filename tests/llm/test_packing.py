import collections
import gc
import pathlib
import random
import re
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from circadia.llm import lines, packing
from circadia.llm.text import slices
from circadia.llm.tokens import encoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "  lead", "trail  ", "a\n b\n\nc", "don't we'll 'S x's 12ab3 4", "a \n\n b", "İstanbul ΑΣ Σ", "日本語 テスト",
       "a\tb\r\n\x0b c", "<|endoftext|> x <|startoftext|>", "x\x1cy z", "🙂🙂 hi", "\n", "ﬁ Å µ ſ K", "a  b \n\n c", "é́ é,", "x y"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_those_of_whole_texts(file, odd_rows):
    made = encoder(public_tokenizers.path(file))
    texts = ODD + [t for _, t in odd_rows]
    ids, at = made.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert np.array_equal(made.encode_whole(text or ""), ids[at[i] : at[i + 1]]), text
        one, _ = made.encode(pa.array([text], pa.string()))
        assert np.array_equal(made.encode_whole(text or ""), one), text


def test_worker_lets_its_words_go_when_it_turns_to_other_texts(spark, odd_docs):
    """Encoding tasks share one encoder; it is gone once the worker slices texts for anything else."""

    def alive():
        gc.collect()
        return [x() for x in known if x() is not None]

    texts = pa.RecordBatch.from_pydict({"text": ["some words", None, "more"]})
    known = [weakref.ref(encoder(WORD_BPE))]
    encoder(WORD_BPE).encode(texts.column(0))
    assert [p.num_rows for p in slices([texts], "text", keep=True)] == [3]
    assert encoder(WORD_BPE) is known[0]()
    assert [p.num_rows for p in slices([texts], "text")] == [3]
    assert not alive()
    # the pieces of a table are those of a worker that has encoded nothing yet, whatever came between
    first = sorted(map(tuple, packing.pieces(odd_docs, WORD_BPE).collect()), key=repr)
    lines.occurrences(odd_docs).count()
    assert sorted(map(tuple, packing.pieces(odd_docs, WORD_BPE).collect()), key=repr) == first


def test_free_memory_goes_back_behind_the_last_slice():
    """What a task has freed does not stay with a worker that waits."""

    def held() -> float:
        found = re.search(r"^Anonymous: +(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text(), re.M)
        return int(found[1]) / 1024

    blocks = [np.ones(2500) for _ in range(5000)]
    pins = blocks[::50]  # freed pages lie between blocks that are still in use
    del blocks
    before = held()
    texts = pa.RecordBatch.from_pydict({"text": ["some words", None]})
    assert [p.num_rows for p in slices([texts], "text")] == [2]
    assert len(pins) == 100 and held() < before - 50


def one_by_one(lengths, capacity):
    """Number of bins when pieces are packed one after the other."""
    large = sorted(x for x in lengths if 3 * x > capacity)
    bins = []
    while large:
        a = large.pop()
        fits = [x for x in large if x <= capacity - a]
        if fits:
            large.remove(max(fits))
        bins.append(capacity - a - (max(fits) if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        open_ = [(gap, i) for i, gap in enumerate(bins) if gap >= x]
        if open_:
            bins[min(open_)[1]] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(60))
def test_plan_packs_like_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 30, 100])
    lengths = [rng.randint(1, capacity) if seed % 2 else max(1, min(capacity, int(rng.lognormvariate(1.5, 1)))) for _ in range(rng.randint(0, 120))]
    plan = packing.plan(collections.Counter(lengths), capacity)
    bins = collections.defaultdict(list)
    for length, runs in plan.runs.items():
        for (rank, first, offset), (next_rank, _, _) in zip(runs, [*runs[1:], (plan.used[length], 0, 0)]):
            for k in range(next_rank - rank):
                bins[first + k].append((offset, length))
    assert sorted(length for b in bins.values() for _, length in b) == sorted(lengths)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plan.bins == one_by_one(lengths, capacity)


def check_packed(rows, docs, capacity):
    encode = encoder(WORD_BPE).encode_whole
    expected, sequences = collections.Counter(), collections.defaultdict(list)
    for doc_id, text in docs:
        ids = np.append(encode(text or ""), [1]).astype("<u4")
        for k in range(-(-len(ids) // capacity)):
            cut = ids[k * capacity : (k + 1) * capacity]
            expected[doc_id, k, k * capacity, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents_are_packed(odd_docs, odd_rows, no_docs):
    rows = packing.pack_documents(odd_docs, WORD_BPE, capacity=500).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, odd_rows, 500) <= -(-total // 500) + 2
    assert packing.pack_documents(no_docs, WORD_BPE).collect() == []


def test_sequences_hold_the_pieces(odd_docs):
    made = packing.packed(packing.pieces(odd_docs.where("doc_id < 30"), WORD_BPE, capacity=300), 300)
    by = collections.defaultdict(list)
    for r in made.collect():
        by[r.sequence_id].append((r.offset, bytes(r.ids)))
    for r in packing.sequences(made).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(by[r.sequence_id])) and len(r.ids) == 4 * r.length


def test_one_length_for_most_pieces(spark):
    items = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 7L, id % 40 + 1) as length")
    rows = packing.packed(items, 64).collect()
    bins = collections.Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert len(rows) == 3000 and max(bins.values()) <= 64
    assert len(bins) == one_by_one([r.length for r in rows], 64)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_are_their_own_ids(file):
    path = public_tokenizers.path(file)
    texts = ["a<|endoftext|>b", "<|startoftext|> x <|endoftext|>", "plain words", "<|ENDOFTEXT|>", "one <|endoftext|>\n<|endoftext|>two", None, "é <|endoftext|"]
    ids, ends = encoder(path).encode(pa.array(texts))
    expected = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected
