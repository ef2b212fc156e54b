"""A context-mixing range coder for token ids, in blocks that are reset and checked on their own.

A block's ids are predicted from the two ids before them. The id that last followed the same
two ids, and the one that last followed the same one id, are each kept with a confidence. What
is coded is a symbol: order 2 was right, order 1 was right, or the number of bits of the id, whose
lower bits follow. Symbols are counted by the order-2 confidence, by the order-1
confidence, and without context (order 0); the three counts are added, so the one with more
evidence weighs more, and the mixture drives a carryless range coder. Coder and model step through
many blocks at once, one id of each.

Layout: magic, ids in a block, ids, blocks; for each block the number of its 32-bit words and the
CRC-32 of its ids; then the words. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDM"
BLOCK = 2048
SYMBOLS, LEVELS = 19, 3
TOTAL_BITS = 12
SLOTS_1, SLOTS_2 = 1 << 10, 1 << 11
#: The mixture is made anew after these many ids of a block, and then every 64.
RENEW = {8, 16, 32}
#: A word is sent when low's upper half is settled; a span below BOTTOM is cut at the next border, so it is.
WORD, HALF, BOTTOM = np.uint64(32), np.uint64(1 << 32), np.uint64(1 << 28)
LENGTHS = np.array([int(k).bit_length() for k in range(1 << 16)], np.int64)
#: How many lower bits follow a symbol, and a mask of them.
BITS = np.array([max(s - 3, 0) for s in range(SYMBOLS)], np.uint64)
LOWER = np.array([(1 << max(s - 3, 0)) - 1 for s in range(SYMBOLS)], np.int32)
#: What a symbol counts for, and what symbols count for before any has been met.
STEP = 24
#: Four 16-bit borders lie in one 64-bit number, the top bit of each is set.
FIELDS, TOPS = 4, np.uint64(0x8000800080008000)
ONES = np.uint64(0x0001000100010001)


class Model:
    """Predictions and counts of some blocks, all at the same place.

    In all tables but the two of ids the blocks lie side by side, so that steps run along them.
    """

    def __init__(self, lanes: int, searched: bool = False):
        self.lanes = lanes
        self.one, self.two = np.zeros(lanes * SLOTS_1, np.int32), np.zeros(lanes * SLOTS_2, np.int32)
        self.base_1, self.base_2 = np.arange(lanes) * SLOTS_1, np.arange(lanes) * SLOTS_2
        self.lane = np.arange(lanes)
        self.stride = LEVELS * LEVELS * lanes
        self.met = np.zeros(SYMBOLS * self.stride, np.int32)
        self.before, self.earlier = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.start = np.full((SYMBOLS, LEVELS, LEVELS, 1), 3, np.int32)
        for level in range(LEVELS):
            self.start[0, level] += 4 * level
            self.start[1, :, level] += 2 * level
        self.cum = np.zeros((SYMBOLS + 1, self.stride), np.int16)
        self.flat = self.cum.reshape(-1)
        words = -(-(SYMBOLS - 1) // FIELDS)
        self.borders = np.full((words, self.stride, FIELDS), -1, np.int16) if searched else None
        self.renew()

    def renew(self) -> None:
        """Counts by order-2 confidence, by order-1 confidence and without context, added."""
        met = self.met.reshape(SYMBOLS, LEVELS, LEVELS, self.lanes)
        by_2, by_1 = met.sum(2, dtype=np.int32), met.sum(1, dtype=np.int32)
        by_2 += by_2.sum(1, keepdims=True, dtype=np.int32)
        mixed = by_2[:, :, None] + by_1[:, None]
        mixed += self.start
        # Every product is rounded in the same way on both sides; one unit is kept back for that.
        mixed = mixed.reshape(SYMBOLS, -1)
        parts = mixed.astype(np.float32)
        parts *= np.float32((1 << TOTAL_BITS) - SYMBOLS - 1) / mixed.sum(0, dtype=np.int32).astype(np.float32)
        parts += np.float32(1)
        parts = parts.astype(np.int16)
        cum = self.cum
        for k in range(SYMBOLS - 1):
            np.add(cum[k], parts[k], out=cum[k + 1])
        cum[-1] = 1 << TOTAL_BITS
        if self.borders is not None:
            for k in range(SYMBOLS - 1):
                np.bitwise_or(cum[k + 1], np.int16(-0x8000), out=self.borders[k // FIELDS, :, k % FIELDS])

    def search(self, value: np.ndarray) -> np.ndarray:
        """The symbol in whose span each value lies."""
        found = self.borders.view(np.uint64)[..., 0].take(self.row, axis=1)
        found -= (value + np.uint64(1)) * ONES
        found &= TOPS
        above = np.bitwise_count(found)
        return (len(found) * FIELDS - above.sum(0, dtype=np.uint8)).astype(np.int64)

    def predict(self, n: int) -> None:
        """For the first n blocks."""
        hashed = self.before[:n] * 40503
        self.at_1 = (hashed >> 4 & SLOTS_1 - 1) + self.base_1[:n]
        self.at_2 = ((hashed ^ self.earlier[:n] * 48271) >> 3 & SLOTS_2 - 1) + self.base_2[:n]
        seen_1, seen_2 = self.one.take(self.at_1), self.two.take(self.at_2)
        self.guess_1, self.guess_2 = seen_1 >> 2, seen_2 >> 2
        self.level_1, self.level_2 = seen_1 & 3, seen_2 & 3
        self.row = (self.level_2 * LEVELS + self.level_1) * np.int64(self.lanes) + self.lane[:n]

    def spans(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where symbols stand in the counts, and what lies below and inside their spans."""
        at = symbol * self.stride + self.row
        below = self.flat.take(at)
        return at, below.astype(np.uint64), (self.flat.take(at + self.stride) - below).astype(np.uint64)

    def update(self, ids: np.ndarray, at: np.ndarray, hit_1: np.ndarray, hit_2: np.ndarray) -> None:
        n = len(ids)
        self.met[at] += STEP
        fresh = ids << 2
        self.one[self.at_1] = (self.level_1 + (self.level_1 < LEVELS - 1)) * hit_1 + fresh
        self.two[self.at_2] = (self.level_2 + (self.level_2 < LEVELS - 1)) * hit_2 + fresh
        self.earlier[:n] = self.before[:n]
        self.before[:n] = ids


def _due(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Blocks with a word to send or to take. After it the span is wide enough for the next id."""
    settled = (low ^ (low + span)) < HALF
    short = span < BOTTOM
    short &= ~settled
    if short.any():
        where = short.nonzero()[0]
        span[where] = (np.uint64(0) - low[where]) & (BOTTOM - np.uint64(1))
        settled |= short
    return settled.nonzero()[0]


def _steps(ids: int, block: int) -> tuple[int, int]:
    """Blocks, and ids of the last one."""
    lanes = -(-ids // block)
    return lanes, ids - (lanes - 1) * block


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids below 2^16 as coded blocks."""
    ids = np.asarray(ids)
    if not len(ids):
        return MAGIC + struct.pack("<IQI", block, 0, 0)
    assert 0 <= ids.min() and ids.max() < 1 << 16
    lanes, last = _steps(len(ids), block)
    grid = np.zeros((lanes, block), np.int32)
    grid.reshape(-1)[: len(ids)] = ids
    by_step = np.ascontiguousarray(grid.T)
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    cap = block + 4  # an id takes 27 bits at most
    # Word k of all blocks, then word k + 1: blocks send theirs at about the same time.
    words, used, lane = np.zeros(cap * lanes, np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)
    for step in range(block if lanes > 1 else last):
        n = lanes if step < last else lanes - 1
        x = by_step[step, :n]
        model.predict(n)
        hit_1, hit_2 = model.guess_1 == x, model.guess_2 == x
        symbol = LENGTHS.take(x)
        symbol += 1
        symbol *= ~hit_1
        symbol += 1
        symbol *= ~hit_2
        at, below, inside = model.spans(symbol)
        lo, sp = low[:n], span[:n]
        sp >>= np.uint64(TOTAL_BITS)
        lo += sp * below
        sp *= inside
        sp >>= BITS.take(symbol)
        lo += sp * (x & LOWER.take(symbol)).astype(np.uint64)
        model.update(x, at, hit_1, hit_2)
        due = _due(lo, sp)
        if len(due):
            send = lo[due]
            words[used[due] * lanes + due] = (send >> WORD).astype(np.uint32)
            used[due] += 1
            lo[due] = send << WORD
            sp[due] <<= WORD
        if step + 1 in RENEW or not (step + 1) % 64:
            model.renew()
    for k in range(2):
        words[used * lanes + lane] = (low >> np.uint64(32 - 32 * k)).astype(np.uint32)
        used += 1
    heads = np.empty((lanes, 2), "<u4")
    heads[:, 0] = used
    plain = ids.astype("<u4")
    heads[:, 1] = [zlib.crc32(plain[k * block : (k + 1) * block].tobytes()) for k in range(lanes)]
    by_block = words.reshape(cap, lanes)[: used.max()].T.astype("<u4")
    body = b"".join(by_block[k, :u].tobytes() for k, u in enumerate(used.tolist()))
    return MAGIC + struct.pack("<IQI", block, len(ids), lanes) + heads.tobytes() + body


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of encode_ids(). Raises ValueError where the data is damaged."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not coded ids")
    block, total, lanes = struct.unpack_from("<IQI", data, 4)
    if not total:
        return np.zeros(0, np.int32)
    if not block or lanes != -(-total // block) or len(data) < 20 + 8 * lanes:
        raise ValueError("broken header")
    heads = np.frombuffer(data, "<u4", 2 * lanes, 20).reshape(lanes, 2).astype(np.int64)
    if (len(data) - 20) % 4:
        raise ValueError("broken length")
    body = np.frombuffer(data[20 + 8 * lanes :], "<u4")
    if len(body) != heads[:, 0].sum():
        raise ValueError("broken length")
    body = np.concatenate([body, np.zeros(8, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(heads[:-1, 0])])
    lanes, last = _steps(total, block)
    model = Model(lanes, searched=True)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = (code << WORD) | body[np.minimum(at, len(body) - 1)]
        at = at + 1
    by_step = np.zeros((block, lanes), np.int32)
    full = np.uint64((1 << TOTAL_BITS) - 1)
    for step in range(block if lanes > 1 else last):
        n = lanes if step < last else lanes - 1
        model.predict(n)
        lo, sp = low[:n], span[:n]
        sp >>= np.uint64(TOTAL_BITS)
        sp |= sp == 0
        symbol = model.search(np.minimum((code[:n] - lo) // sp, full))
        at_symbol, below, inside = model.spans(symbol)
        lo += sp * below
        sp *= inside
        sp >>= BITS.take(symbol)
        sp |= sp == 0
        lower = LOWER.take(symbol)
        rest = np.minimum((code[:n] - lo) // sp, lower.astype(np.uint64))
        lo += sp * rest
        x = rest.astype(np.int32)
        x += lower
        x += symbol > 2
        for hit, guess in ((symbol == 1, model.guess_1), (symbol == 0, model.guess_2)):
            np.copyto(x, guess, where=hit)
        by_step[step, :n] = x
        model.update(x, at_symbol, model.guess_1 == x, model.guess_2 == x)
        due = _due(lo, sp)
        if len(due):
            code[due] = (code[due] << WORD) | body[np.minimum(at[due], len(body) - 1)]
            at[due] += 1
            lo[due] <<= WORD
            sp[due] <<= WORD
        if step + 1 in RENEW or not (step + 1) % 64:
            model.renew()
    ids = np.ascontiguousarray(by_step.T).reshape(-1)[:total]
    plain = ids.astype("<u4")
    if any(zlib.crc32(plain[k * block : (k + 1) * block].tobytes()) != heads[k, 1] for k in range(lanes)):
        raise ValueError("broken block")
    return ids
