"""Token ids of Arrow text columns by the tokenizers library, with a memory of words.

The two vocabularies cut texts before they look for merges, never within a run of
letters, so a text's ids are the ids of its words end to end. A batch of texts is cut
by its bytes at once: before white space, behind a line feed, and between a letter and a
mark that follows it. Each distinct word of the batch is looked up once. Workers keep
the ids of words they have met, at most `most` of them and those of one batch, and ask the
library for new ones only. Texts in which cuts could depend on their surroundings (other white
space than single spaces and line feeds, control characters, special tokens) go to the library whole.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LATIN = [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]
#: A word of ASCII and Latin-1 letters. Its ids are those of its letters.
_PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: White space and control characters that a text's cuts may depend on, and special tokens.
_ODD = r"[\x00-\x08\x0e-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|<\|"
#: The same where a space before a word is part of it: line feeds and spaces in a row or at the end, tabs.
_ODD_SPACED = _ODD + r"|[ \n][ \n]|[\t\r\x0b\x0c]|[ \n]\z"
#: Kinds of bytes. An apostrophe is no mark, since it may begin a contraction.
_OTHER, _SPACE, _LETTER, _MARK = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27]] = _MARK
_KIND[[b for b in range(33, 127) if chr(b).isalpha()]] = _LETTER
_SECOND = np.zeros(256, bool)
_SECOND[_LATIN] = True
#: Texts are encoded in batches of about this many bytes; a longer document is one batch.
BATCH_BYTES = 8 << 20
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def _words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, and the end of the data. Each text begins a word."""
    kind = _KIND[data]
    letter = kind == _LETTER
    first = np.flatnonzero(data[:-1] == 0xC3)
    letter[first[_SECOND[data[first + 1]]] + 1] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = kind == _SPACE
    cut[1:-1] |= letter[:-1] & (kind[1:] == _MARK)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """encode() gives the ids that the library gives for whole texts without added special tokens."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.spaced = self.tokenizer.normalizer is None  # a word's ids depend on the space before it
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        self._forget()

    def _forget(self) -> None:
        """The ids of word k are numbers start[k] to start[k + 1] of the pool."""
        self.memory: dict[bytes, int] = {}
        self.pool, self.start = array("i"), array("q", [0])

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        pool, start, memory = self.pool, self.start, self.memory
        plain = pc.match_substring_regex(pa.array(words, pa.string()), _PLAIN).to_numpy(zero_copy_only=False)
        runs = [words[k] for k in np.flatnonzero(plain).tolist()]
        # All at once; a digit stands between them, as they hold none.
        shown = b"0".join(runs)
        if not self.spaced:
            shown = shown.replace(b" ", b"").decode().lower().encode()
        shown = shown.decode("latin-1").translate(self.letters).split("0")
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(letters)] for letters in shown] if runs else []
        rest = [words[k] for k in np.flatnonzero(~plain).tolist()]
        found += [self._whole(word.decode()) for word in rest]
        memory.update(zip(runs + rest, range(len(start) - 1, len(start) - 1 + len(found)), strict=True))
        start.extend((len(pool) + np.cumsum([len(ids) for ids in found])).tolist())
        pool.extend(chain.from_iterable(found))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) end to end, and where each text's ids start."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        return self.encode_bytes(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that lie end to end, and their offsets."""
        rows = len(offsets) - 1
        data, offsets = np.ascontiguousarray(data[offsets[0] : offsets[-1]]), (offsets - offsets[0]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if len(self.memory) > self.most:
            self._forget()
        blob = pa.py_buffer(data)
        texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), blob)
        odd = pc.match_substring_regex(texts, _ODD_SPACED if self.spaced else _ODD).to_numpy(zero_copy_only=False)

        begin = _words(data, offsets)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), blob])
        edges = np.searchsorted(begin, offsets)
        if odd.any():
            words = words.filter(pa.array(np.repeat(~odd, np.diff(edges))))
            edges = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(edges)))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.memory]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.memory.__getitem__, distinct), np.int64, len(distinct))
        ids, per_word = self._gather(number[coded.indices.to_numpy()])
        at = per_word[edges]
        if not odd.any():
            return ids, at
        parts = [np.array(self._whole(texts[k].as_py()), np.int32) if odd[k] else ids[at[k] : at[k + 1]] for k in range(rows)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and where each word's ids start."""
        if not len(numbers):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        pool, start = np.array(self.pool, np.int32), np.array(self.start, np.int64)
        begin = start[numbers]
        lengths = start[numbers + 1] - begin
        at = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(begin - at[:-1], lengths)
        where += np.arange(at[-1])
        return pool[where], at


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text's ids."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
