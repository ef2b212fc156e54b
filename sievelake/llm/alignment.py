"""Longest common subsequences of long sequences, row by row on whole machine words."""

from __future__ import annotations

import numpy as np

#: Bits of rows that are kept to read an alignment back; larger problems are halved.
MOST_BITS = 1 << 28


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """After each item of `a`, the columns of `b` at which the common length does not grow (bits); all rows or the last."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    mask = (1 << len(b)) - 1
    v, out = mask, []
    for x in a:
        u = v & places.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & mask
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(v: int, n: int) -> np.ndarray:
    """Common lengths with the first 0 to n items, from a row of bits."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of one longest common subsequence, ascending. The same sequences always give the same pairs."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            pairs.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            pairs.append((i1, j1))
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n > 1 and n * m > MOST_BITS:
            half = i0 + n // 2
            head = _lengths(_rows(a[i0:half], b[j0:j1], False)[0], m)
            tail = _lengths(_rows(a[half:i1][::-1], b[j0:j1][::-1], False)[0], m)
            cut = j0 + int(np.argmax(head + tail[::-1]))
            todo += [(i0, half, j0, cut), (half, i1, cut, j1)]
            continue
        rows = _rows(a[i0:i1], b[j0:j1], True)
        i, j = n, m
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    pairs.append((i0 + i, j0 + j))
    return sorted(pairs)
