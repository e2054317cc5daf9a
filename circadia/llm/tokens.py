"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once per worker.

Both files used here split texts before the merges, and no piece of that split reaches from one
word into the white space after it. So a text's ids are the ids of its words in a row: of the word
alone where the tokenizer drops white space, of the white space before it with the word where it
keeps it. Texts with white space outside ASCII and texts that hold one of the file's added tokens are
encoded whole, by the file as it is: an added token in a text is its own id.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .text import KEPT, each, ranges, utf8, words

#: Distinct words that a worker remembers, in each of two generations.
REMEMBERED = 300_000

_OTHER_SPACE = "[\u0085   -     　\u001c-\u001f]"
# Below U+0250 no character is changed by composition, and lower case is the same everywhere.
_PLAIN = regex.compile("[\u0000-\u001b -\u0084\u0086-\u009f¡-ɏ]*")


_IS_MARK, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(b".,;:!?")] = True
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
# second bytes of U+00C0 to U+00FF, which are letters but for the signs of times and division
_IS_SECOND = np.zeros(256, bool)
_IS_SECOND[[b for b in range(128, 192) if b not in (0x97, 0xB7)]] = True


def _marks(data: np.ndarray) -> np.ndarray:
    """Where a mark follows a letter: a piece always ends there, and most words are known without their mark."""
    at = np.flatnonzero(_IS_MARK[data])
    at = at[at > 0]
    before = data[at - 1]
    letter = _IS_LETTER[before] | (_IS_SECOND[before] & (data[np.maximum(at - 2, 0)] == 0xC3) & (at > 1))
    return at[letter]


def _bytes_as_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Remembered(dict):
    """Values by key, made on demand; the least recently made half goes when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as unsigned 16-bit numbers; the vocabularies have fewer than 65,536 entries."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        self.model = self.whole.model
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # a normalizer may lower the case of a text before its added tokens are looked for
        self.added = "(?i)" + "|".join(re.escape(t) for t in sorted(added)) if added else None
        sample = self.encode_whole("a b"), self.encode_whole("a  b")
        self.drops_space = bool(np.array_equal(*sample))
        self.letters = _bytes_as_letters()
        self.leads = 0 if self.drops_space else 1  # a word of plain letters is one piece with the blank before it
        if self.drops_space:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.split = regex.compile(pattern)
        self.words = _Remembered(self.encode_word)
        self.pieces = _Remembered(self.encode_piece)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)

    def encode_piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode_word(self, word: bytes) -> bytes:
        text = word.decode()
        body = text[self.leads :]
        if body and (text.isascii() or max(body) < "ɐ") and (not self.leads or text[0] == " "):
            # letters alone are one piece, and so is a mark after them
            low = body.lower() if self.drops_space else body
            lead = text[: self.leads]
            if low.isalpha():
                # the word is remembered itself, so its one piece need not be
                return self.encode_piece(lead + low) if lead else self.pieces[low]
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return self.pieces[lead + low[:-1]] + self.pieces[low[-1]]
        if _PLAIN.fullmatch(text) is None:
            return self.encode_whole(text).tobytes()
        if self.drops_space:
            text = text.lower()
        found = self.split.findall(text)
        if len(found) == 1:
            return self.encode_piece(found[0])
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more than texts)."""
        filled = texts.fill_null("")
        rare = pc.match_substring_regex(filled, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        if self.added:
            rare = rare | pc.match_substring_regex(filled, self.added).to_numpy(zero_copy_only=False)
        if not rare.any():
            return self._by_words(texts)
        parts, counts = [], np.zeros(len(texts), np.int64)
        for row in range(len(texts)):
            one = texts.slice(row, 1)
            ids = self.encode_whole(one[0].as_py()) if rare[row] else self._by_words(one)[0]
            parts.append(ids)
            counts[row] = len(ids)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            found = words(texts)
            of, distinct = found.coded()
            first = found.first
        else:
            of, distinct, first = self._with_space(texts)
        values = list(map(self.words.__getitem__, each(distinct)))
        flat = np.frombuffer(b"".join(values), np.uint16)
        length = np.fromiter(map(len, values), np.int64, len(values)) // 2
        start = np.cumsum(length) - length
        counts = length[of]
        ids = flat[ranges(start[of], counts)] if len(of) else flat
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[first]

    def _with_space(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Each word with the white space before it; white space at a text's end on its own."""
        data, places = utf8(texts)
        found = words(texts)
        # cut where a word ends; what is left up to a text's end is its last piece
        cut = np.zeros(len(data) + 1, bool)
        cut[found.end] = cut[places] = True
        cut[_marks(data)] = True
        cuts = np.flatnonzero(cut)
        column = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        )
        coded = column.dictionary_encode()
        first = np.searchsorted(cuts, places)
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process, with what it remembers, until the worker turns to other texts."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]
