"""GIF media: stored animations, their LZW streams, composited frames and colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.words import pieces, text_bytes

CLEAR_AT = 4096  # codes a table can hold
#: Samples of a stored row, rows of a frame, and hundredths of a second that a frame is shown.
WIDTH, ROWS, DELAY = 192, 64, 10
#: Colour bins of each channel.
BINS = 8


FULL = np.full(CLEAR_AT, 12, np.int64)
FULL_BEGINS = np.arange(CLEAR_AT + 1) * 12


class Frame(NamedTuple):
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    canvas: np.ndarray  # height x width x 3 of the whole screen, as shown


@cache
def code_widths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and where each begins; each code but the first adds an entry to the table.

    Long enough for a table to fill; after that all codes have 12 bits.
    """
    entries = (1 << size) + 2 + np.maximum(np.arange(CLEAR_AT) - 1, 0)
    bits = np.minimum(np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1), 12)
    return bits, np.concatenate([[0], np.cumsum(bits)])


@cache
def _single(clear: int) -> list[bytes]:
    return [bytes([k]) for k in range(clear)] + [b"", b""]


def lzw_codes(data: bytes, size: int = 8) -> tuple[list[int], list[int]]:
    """Greedy LZW codes, and where in them each run after a clear code begins."""
    clear = 1 << size
    out, starts, table, entry = [clear], [1], {}, clear + 2
    if data:
        prefix, get, send = data[0], table.get, out.append
        for byte in data[1:]:
            code = get(prefix << 8 | byte)
            if code is not None:
                prefix = code
                continue
            send(prefix)
            if entry < CLEAR_AT:
                table[prefix << 8 | byte] = entry
                entry += 1
            else:
                send(clear)
                starts.append(len(out))
                table, entry = {}, clear + 2
                get = table.get
            prefix = byte
        out.append(prefix)
    out.append(clear + 1)
    return out, starts


def pack_codes(codes: list[int], starts: list[int], size: int = 8) -> bytes:
    runs = np.diff([*starts, len(codes)])
    schedule = code_widths(size)[0]
    width = np.concatenate([[size + 1], *[schedule[:n] for n in runs.tolist()]])
    at = np.zeros(len(width) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    value = np.array(codes, np.int64) << (at[:-1] & 7)
    byte, out = at[:-1] >> 3, np.zeros((int(at[-1]) + 7 >> 3) + 2, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, (value >> (8 * k)) & 255, len(out)).astype(np.int64)
    return out[: int(at[-1]) + 7 >> 3].astype(np.uint8).tobytes()


def lzw_samples(stream: bytes, size: int) -> bytes:
    """Samples of an LZW stream. A damaged or unfinished stream gives what it holds up to there."""
    clear, end = 1 << size, (1 << size) + 1
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    total, at, out = 8 * len(stream), 0, []
    first, (schedule, begins) = _single(clear), code_widths(size)
    while at < total:
        table, before, met = first.copy(), None, 0
        done = False
        while not done:
            widths, cum = (schedule, begins) if not met else (FULL, FULL_BEGINS)
            usable = int(np.searchsorted(cum, total - at, side="right")) - 1
            if usable <= 0:
                return b"".join(out)
            usable = min(usable, CLEAR_AT)
            place, widths = at + cum[: usable + 1], widths[:usable]
            byte = place[:-1] >> 3
            codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (place[:-1] & 7)) & ((1 << widths) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            count = int(stop[0]) if len(stop) else usable
            run = codes[:count]
            # Entries there are when each code is read: the first code adds none, every other one. A code
            # may name the entry that it is about to complete, but none beyond.
            newest = len(table) + np.maximum(np.arange(count) - (before is None), 0)
            if not (run > newest).any():
                entries = run.tolist()
                if before is None and entries:
                    before = table[entries[0]]
                    out.append(before)
                    del entries[0]
                add, send = table.append, out.append
                for code in entries:
                    try:
                        entry = table[code]
                    except IndexError:
                        entry = before + before[:1]
                    send(entry)
                    add(before + entry[:1])
                    before = entry
                del table[CLEAR_AT:]
            else:
                for code in run.tolist():
                    if code < len(table):
                        entry = table[code]
                    elif before is not None and code == len(table):
                        entry = before + before[:1]
                    else:
                        return b"".join(out)
                    out.append(entry)
                    if before is not None and len(table) < CLEAR_AT:
                        table.append(before + entry[:1])
                    before = entry
            if len(stop):
                if codes[count] == end:
                    return b"".join(out)
                at, done = int(place[count + 1]), True
            else:
                at, met = int(place[usable]), met + usable
    return b"".join(out)


def blocks(data: bytes) -> bytes:
    """Data sub-blocks, with the empty one that ends them."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """An animation whose palette is a grey ramp and whose frames hold the payload row by row; its length must be a multiple of width."""
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + blocks(pack_codes(*lzw_codes(part))))
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames as shown: each is drawn over what its predecessor's disposal left (kept, cleared, or put back).

    Transparent samples leave what is below. Background and undrawn places are black. Raises
    ValueError where the data isn't a GIF or breaks off within a header.
    """
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at = 13
        shared, at = _palette(data, at, flags)
        canvas = np.zeros((high, wide, 3), np.uint8)
        delay, disposal, transparent = 0, 0, None
        while at < len(data):
            kind, at = data[at], at + 1
            if kind == 0x21:
                label, at = data[at], at + 1
                body, at = _joined(data, at)
                if label == 0xF9 and len(body) >= 4:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            elif kind == 0x2C:
                left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
                own, at = _palette(data, at + 9, flags)
                colours = own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8)
                size, at = data[at], at + 1
                stream, at = _joined(data, at)
                got = np.frombuffer(lzw_samples(stream, size), np.uint8)[: width * height]
                samples = np.zeros(width * height, np.uint8)
                samples[: len(got)] = got
                drawn = np.zeros(width * height, bool)
                drawn[: len(got)] = True
                samples, drawn = samples.reshape(height, width), drawn.reshape(height, width)
                if flags & 0x40:
                    order = np.concatenate([np.arange(s, height, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    rows = np.empty_like(order)
                    rows[order] = np.arange(height)
                    samples, drawn = samples[rows], drawn[rows]
                before = canvas.copy() if disposal == 3 else None
                area = canvas[top : top + height, left : left + width]
                samples, drawn = (x[: area.shape[0], : area.shape[1]] for x in (samples, drawn))
                seen = drawn if transparent is None else drawn & (samples != transparent)
                shown = colours.take(samples if len(colours) == 256 else samples.astype(np.int64) % len(colours), axis=0)
                if seen.all():
                    area[:] = shown
                else:
                    area[seen] = shown[seen]
                yield Frame(10 * delay, left, top, width, height, disposal, canvas.copy())
                if disposal == 2:
                    area[:] = 0
                elif disposal == 3:
                    canvas = before
                delay, disposal, transparent = 0, 0, None
            elif kind == 0x3B:
                return
            else:
                raise ValueError("unknown block")
    except (struct.error, IndexError) as broken:
        raise ValueError("broken GIF") from broken


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    table = np.frombuffer(data[at : at + n], np.uint8)
    if len(table) < n:
        raise ValueError("broken palette")
    return table.reshape(-1, 3), at + n


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def store_gifs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's UTF-8 (null: empty), filled up with spaces to whole rows, at least one, as a GIF in `media`, and its length in `n_bytes`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, offsets = text_bytes(batch.column("_text"))
            media = []
            for k in range(batch.num_rows):
                payload = data[offsets[k] : offsets[k + 1]].tobytes()
                media.append(encode_gif(payload + b" " * (-len(payload) % WIDTH if payload else WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(work, f"key {dict(df.dtypes)[key]}, n_bytes bigint, media binary")


def read_gifs(media: DataFrame, channels: int = 3) -> DataFrame:
    """Timed frames of each `media`, with colour histograms, and the samples of the frames' own areas.

    `frames` lists delay, place, size, disposal and a histogram of BINS bins for each of red, green and
    blue of the frame's area as shown; `samples` has the first `channels` channels of those areas, frame by frame.
    Null media and data that aren't a GIF give null frames and samples. Other columns are carried along; an
    empty table gives an empty one.
    """
    carried = [f for f in media.schema.fields if f.name not in ("frames", "samples")]
    one = "struct<delay_ms: int, left: int, top: int, width: int, height: int, disposal: int, histogram: array<bigint>>"
    kind = pa.struct([*[(c, pa.int32()) for c in ("delay_ms", "left", "top", "width", "height", "disposal")], ("histogram", pa.list_(pa.int64()))])

    def show(data: bytes) -> tuple[list[dict], bytes]:
        frames, samples = [], []
        for f in decode_gif(data):
            area = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            bins = (area // np.uint8(256 // BINS)).reshape(-1, 3) + np.arange(0, 3 * BINS, BINS)
            histogram = np.bincount(bins.reshape(-1), minlength=3 * BINS).tolist()
            frames.append({**{c: getattr(f, c) for c in ("delay_ms", "left", "top", "width", "height", "disposal")}, "histogram": histogram})
            samples.append(area[:, :, :channels].tobytes())
        return frames, b"".join(samples)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                frames, samples = [], []
                for data in batch.column("media"):
                    try:
                        found = show(data.as_py()) if data.is_valid else (None, None)
                    except ValueError:
                        found = (None, None)
                    frames.append(found[0])
                    samples.append(found[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], pa.array(frames, pa.list_(kind)), pa.array(samples, pa.binary())], names=[*[f.name for f in carried], "frames", "samples"])

    schema = media.select(*[F.col(f"`{f.name}`") for f in carried]).limit(0).selectExpr("*", f"cast(null as array<{one}>) as frames", "cast(null as binary) as samples").schema
    return media.select(*[F.col(f"`{f.name}`") for f in carried]).mapInArrow(work, schema)
