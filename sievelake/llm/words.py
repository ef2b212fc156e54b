"""Words of Arrow text columns as flat arrays, with 64-bit hashes of words and of runs of words.

A word is a run of characters other than U+0020 and U+0009 to U+000D. All hashes
are sums of terms times powers of an odd number, so a run's hash is a difference
of two running sums; equal runs have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text is worked on in pieces of about this many bytes; a longer document is one piece.
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers in which every bit depends on all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def seeds(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@cache
def _base(seed: int) -> tuple[int, int]:
    odd = int(seeds(seed, 1)[0]) | 1
    return odd, pow(odd, -1, 1 << 64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the seed's odd number (or of its inverse) modulo 2^64."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        size = 1 << max(10, n.bit_length())
        step = np.full(size, _base(seed)[inverse], np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if size <= 4 * PIECE_BYTES:  # one very long document shall not stay in memory
            _POWERS[seed, inverse] = have
    return have[:n]


def running_hash(values: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(seed, len(values)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the runs [first, last), from running_hash()."""
    return mix64((sums[last] - sums[first]) * powers(seed, len(sums), True)[first])


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in data, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    of_doc: np.ndarray  # first word of each text, and the end
    hash: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a string column end to end, and where each text starts; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums = running_hash(seeds(11, 256)[data], 12)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), run_hash(sums, start, end, 12))


def gram_hashes(words: Words, n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and their first words."""
    lengths = np.maximum(np.diff(words.of_doc) - (n - 1), 0)
    first = np.repeat(words.of_doc[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return run_hash(running_hash(words.hash, seed), first, first + n, seed), first


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
