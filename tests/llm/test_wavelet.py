import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from circadia.llm import wavelet
from circadia.llm.tokens import encoder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["skewed", "one", "empty", "small"])
def test_access_count_and_places(kind):
    rng = np.random.default_rng(3)
    ids = {"skewed": (rng.zipf(1.3, 5000) % 50257), "one": np.zeros(700), "empty": np.zeros(0), "small": np.array([5, 0, 5, 1])}[kind]
    ids = ids.astype(np.uint16)
    ends = np.array([len(ids)])
    shard = wavelet.from_bytes(wavelet.to_bytes(np.array([3]), np.array([False]), ends, ids))
    matrix = shard.matrix
    assert np.array_equal(matrix.decode(), ids) and np.array_equal(shard.ends, ends)
    if len(ids):
        at = rng.integers(0, len(ids), 300)
        assert np.array_equal(matrix.access(at), ids[at])
    for token in {0, 1, 5, 50000, 1 << 20, *ids[:20].tolist()}:
        for first, last in ((0, len(ids)), (len(ids) // 3, len(ids) * 2 // 3)):
            assert matrix.count(token, first, last) == (ids[first:last] == token).sum()
            assert np.array_equal(matrix.places(token, first, last), np.flatnonzero(ids[first:last] == token) + first)


def test_damage_is_noticed():
    raw = bytearray(wavelet.to_bytes(np.array([3]), np.array([False]), np.array([4]), np.arange(4, dtype=np.uint16)))
    raw[-1] ^= 1
    with pytest.raises(ValueError):
        wavelet.from_bytes(bytes(raw))


def test_documents_come_back_in_order(odd_docs, odd_rows, no_docs):
    manifest = wavelet.write_shards(odd_docs, BYTE_BPE, shard_tokens=2000)
    assert manifest.count() > 3
    rows = sorted(wavelet.read_shards(manifest).collect(), key=lambda r: r.start)
    encode, at = encoder(BYTE_BPE).encode_whole, 0
    expected = sorted((i is not None, i or 0, zlib.crc32(np.append(encode(t or ""), [0]).astype("<u4").tobytes())) for i, t in odd_rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in rows) == expected
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [e[:2] for e in expected]
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert wavelet.read_shards(wavelet.write_shards(no_docs, BYTE_BPE)).collect() == []


MARKED = [
    "", None, " a. b", "x.", "É.é,", "a×.b÷,c", "it's.", "'s.", "é.", "—.", "a,b.c;d!?", "A\n.b. ", "中.文,", "ß!ÿ?À;",
    "x ., y", "1.2,3", "a. b.", "À×.", "." * 5 + "a." * 9, " .a", " ,", "a.\n\nb,\n ", "Ã.̀,", "<|endoftext|>.",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    known = encoder(public_tokenizers.path(name))
    for _ in range(2):  # once as new words, once remembered
        ids, at = known.encode(pa.array(MARKED))
        for row, text in enumerate(MARKED):
            assert ids[at[row] : at[row + 1]].tolist() == known.whole.encode(text or "", add_special_tokens=False).ids, text
