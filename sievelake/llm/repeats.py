"""Removal of repeated passages: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.words import SPACE, Words, gram_hashes, mix64, pieces, run_hash, running_hash, seeds, text_bytes, words_of
from sievelake.session import cut_lineage

#: Rows of the sketch, and the most cells (as a power of two) of each; the driver and every worker hold a bit per cell.
DEPTH, MOST_CELL_BITS = 2, 28
BLOCK_BITS = 20
#: Windows that a task gathers before it emits their cells, and before it reduces and emits candidates.
GATHER_CELLS, GATHER = 6_000_000, 1_000_000
LAST = np.iinfo(np.int64).max


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of every window, and its first word."""
    one, first = gram_hashes(words, n, 15)
    again = mix64(words.hash ^ seeds(16, 1)[0])
    return one, (run_hash(running_hash(again, 17), first, first + n, 17) >> np.uint64(32)).astype(np.int32), first


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(hashes ^ seeds(41 + row, 1)[0]) >> np.uint64(64 - bits)).astype(np.int32)


def pack_cells(cells: np.ndarray) -> bytes:
    """Increasing numbers as steps of one byte; larger steps follow in four."""
    steps = np.diff(cells, prepend=0)
    wide = steps >= 255
    return np.uint32(len(cells)).tobytes() + np.where(wide, 255, steps).astype(np.uint8).tobytes() + steps[wide].astype(np.uint32).tobytes()


def unpack_cells(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    steps = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    steps[steps == 255] = np.frombuffer(blob, np.uint32, offset=4 + n)
    return np.cumsum(steps)


def partial_sketches(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """Cells that a task's windows fall in, by sketch row and block, and which of them it has met twice."""

    def emit(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gathered = np.concatenate(hashes)
        out = {"row": [], "block": [], "once": [], "twice": []}
        for row in range(DEPTH):
            cells, counts = np.unique(cells_of(gathered, row, bits), return_counts=True)
            width = min(bits, BLOCK_BITS)
            edges = np.searchsorted(cells, np.arange((1 << (bits - width)) + 1) << width)
            for block in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[block], edges[block + 1])
                inside = cells[part].astype(np.int64) - (block << width)
                for name, value in zip(out, (row, block, pack_cells(inside), pack_cells(inside[counts[part] > 1])), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["twice"], pa.binary())], names=list(out))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count = [], 0
        for batch in pieces(batches, "_text"):
            hashes.append(gram_hashes(words_of(*text_bytes(batch.column("_text"))), n, 15)[0])
            count += len(hashes[-1])
            if count >= GATHER_CELLS:
                yield from emit(hashes)
                hashes, count = [], 0
        if count:
            yield from emit(hashes)

    return texts.select("_text").mapInArrow(work, "row int, block int, once binary, twice binary")


def merged_sketch(partial: DataFrame, bits: int) -> np.ndarray:
    """A bit for each cell whose count over all tasks is two or more, sketch row by row."""
    width = min(bits, BLOCK_BITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(1 << width, np.uint8)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for one in batch.to_pylist():
                here = (one["row"], one["block"])
                if at is not None and here != at:
                    yield closed()
                    counts[:] = 0
                at = here
                for name in ("once", "twice"):
                    cells = unpack_cells(one[name])
                    counts[cells] = np.minimum(counts[cells] + 1, 2)
        if at is not None:
            yield closed()

    dealt = partial.repartition("row", "block").sortWithinPartitions("row", "block")
    out = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    size = (1 << width) // 8
    for one in dealt.mapInArrow(merge, "row int, block int, bits binary").toLocalIterator():
        out[one["row"], one["block"] * size : (one["block"] + 1) * size] = np.frombuffer(one["bits"], np.uint8)
    return out


def estimated_repeated(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    good = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cells = cells_of(hashes[good], row, bits)
        good[good] = (sketch[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return good


def candidate_windows(texts: DataFrame, n: int, bits: int, sketch) -> DataFrame:
    """The first place of each window that is estimated repeated among what a task has gathered; its other places as lists to remove."""
    schema = "one bigint, two int, doc bigint, tie bigint, start int, starts array<int>"

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        one, two, doc, tie, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, tie, doc, two, one))
        one, two, doc, tie, start = (x[order] for x in (one, two, doc, tie, start))
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc != doc[lead]) | (tie != tie[lead]) | (start != start[lead])
        yield _batch(one[new], two[new], doc[new], tie[new], start[new], pa.nulls(int(new.sum()), pa.list_(pa.int32())))
        doc, tie, start = doc[gone], tie[gone], start[gone]
        if len(doc):
            order = np.lexsort((start, tie, doc))
            doc, tie, start = doc[order], tie[order], start[order]
            edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)).astype(np.int32)), pa.array(start.astype(np.int32)))
            # Their own keys, so that nothing else meets them; equal places of two tasks are joined later.
            yield _batch(mix64(doc[edge].view(np.uint64)), mix64(tie[edge].view(np.uint64)).astype(np.int32), doc[edge], tie[edge], np.full(len(edge), -1), lists)

    def _batch(one, two, doc, tie, start, starts) -> pa.RecordBatch:
        columns = [pa.array(one.view(np.int64)), pa.array(two.astype(np.int32)), pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), starts]
        return pa.RecordBatch.from_arrays(columns, names=["one", "two", "doc", "tie", "start", "starts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in pieces(batches, "_text"):
            words = words_of(*text_bytes(batch.column("_text")))
            one, two, first = window_hashes(words, n)
            good = estimated_repeated(sketch.value, one, bits)
            first = first[good]
            row = np.searchsorted(words.of_doc, first, side="right") - 1
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            parts.append((one[good], two[good], doc[row], tie[row], first - words.of_doc[row]))
            count += len(first)
            if count >= GATHER:
                yield from emit(parts)
                parts, count = [], 0
        if count:
            yield from emit(parts)

    return texts.select("doc", "tie", "_text").mapInArrow(work, schema)


def rest_of(texts: DataFrame, n: int) -> DataFrame:
    """Words of each row (doc, tie, _text), and the hash of those that are left without its `places`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            counts, gone, hashes = [], [], []
            places = batch.column("places") if "places" in batch.schema.names else None
            for k, text in enumerate(batch.column("_text")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                cover = np.zeros(len(words) + 1, np.int64)
                if places is not None:
                    start = np.unique(places[k].values.to_numpy())
                    cover[start] += 1
                    cover[start + n] -= 1
                    keep = np.cumsum(cover)[:-1] == 0
                    left = [w for w, good in zip(words, keep.tolist(), strict=True) if good]
                else:
                    left = words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                hashes.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes, pa.string())], names=["doc", "tie", "n_words", "n_removed", "kept_sha256"])

    return texts.mapInArrow(work, "doc bigint, tie bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def removed_places(texts: DataFrame, n: int) -> DataFrame:
    """(doc, tie, places): first words of the windows that also start earlier."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MOST_CELL_BITS, max(16, int(size // 3).bit_length()))
    sketch = spark.sparkContext.broadcast(merged_sketch(partial_sketches(texts, n, bits), bits))
    found = candidate_windows(texts, n, bits, sketch)
    first = F.min(F.struct("doc", "tie")).over(Window.partitionBy("one", "two"))
    later = found.withColumn("_first", first).filter((F.col("start") < 0) | (F.struct("doc", "tie") != F.col("_first")))
    return cut_lineage(
        later.groupBy("doc", "tie").agg(F.concat(F.collect_list(F.when(F.col("start") >= 0, F.col("start"))), F.flatten(F.collect_list("starts"))).alias("places"))
    )


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 20) -> DataFrame:
    """`n_words`, `n_removed` and `kept_sha256` of each row: words covered by windows of n words that also start earlier are removed.

    Earlier means in a row with a smaller integral key, or before in the same row; windows are judged
    on the input. Every task counts its windows' hashes in a count-min sketch, as the
    cells it has met; the sketches are added block by block, and a cell met twice
    marks all its windows. So no repeated window is missed. A second pass groups
    the marked ones by 96 bits of hash. A task first reduces what it has gathered to
    one place for each window, so a passage that is everywhere gives one row for
    millions of windows, not one for each.

    Cells grow with the text up to 2^MOST_CELL_BITS; beyond that the sketch lets more through,
    and the result stays the same. Null and empty texts have no words. A null key comes last. Rows
    with the same key and text are one document and all get its result; of rows with the
    same key and other texts, the smaller text hash is earlier. An empty table gives
    an empty one. Other columns are left out.
    """
    doc = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(int(LAST)))
    repeated = not df.groupBy(doc.alias("doc")).count().filter("count > 1").isEmpty()
    tie = F.xxhash64(F.col(f"`{text}`")) if repeated else F.lit(0).cast("long")
    texts = df.select(doc.alias("doc"), tie.alias("tie"), F.col(f"`{text}`").alias("_text"))
    places = removed_places(texts, n)
    # Rows to cut are found by a coarse table of bounded size first, so that other texts aren't shuffled.
    bucket = F.pmod(F.xxhash64("doc", "tie"), F.lit(1 << 20)).alias("_bucket")
    some = F.broadcast(places.select(bucket).distinct())
    cut = texts.withColumn("_bucket", bucket).join(some, "_bucket", "left_semi").drop("_bucket").join(places, ["doc", "tie"])
    cut = rest_of(cut, n).dropDuplicates(["doc", "tie"]).select("doc", "tie", F.col("n_removed").alias("_gone"), F.col("kept_sha256").alias("_sha"))
    out = rest_of(texts, n).join(cut, ["doc", "tie"], "left")
    real = F.when(F.col("doc") != F.lit(int(LAST)), F.col("doc")).cast(dict(df.dtypes)[key])
    return out.select(real.alias(key), "n_words", F.coalesce("_gone", "n_removed").alias("n_removed"), F.coalesce("_sha", "kept_sha256").alias("kept_sha256"))
