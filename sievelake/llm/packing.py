"""Packing token streams into windows whose sources keep to target proportions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sievelake.llm.common import ROWS_PER_BIN, bins_for, group_key, running, seeded_order
from sievelake.llm.tokens import BATCH_BYTES, encoder, with_end
from sievelake.llm.words import pieces, text_bytes
from sievelake.session import cut_lineage

#: Tasks count the places of quanta with up to this many queues, each against all; beyond it a sort costs less.
MOST_COUNTED = 128


def token_streams(df: DataFrame, key: str, text: str, source: str, vocabulary: str, end_id: int) -> DataFrame:
    """Ids of each row and its place in its source's stream, as far as one task can tell.

    `_ids` holds little-endian unsigned 32-bit numbers. `_before` counts the tokens
    of the same source that the same task (`_part`) has met before.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, met = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in pieces(batches, "_text", BATCH_BYTES):
            ids, at = with_end(*tokens.encode_bytes(*text_bytes(batch.column("_text"))), end_id)
            before = []
            for name, n in zip(batch.column("_source").to_pylist(), np.diff(at).tolist(), strict=True):
                before.append(met.get(name, 0))
                met[name] = before[-1] + n
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((4 * at).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_source"), pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64()), pa.array(np.diff(at)), blobs.cast(pa.binary())],
                names=["_key", "_source", "_part", "_before", "_n", "_ids"],
            )

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), group_key(source).alias("_source"))
    return rows.mapInArrow(encode, f"_key {kind}, _source string, _part int, _before bigint, _n bigint, _ids binary")


def counted_places(queues: list[Row], window: int, quantum: int) -> Callable[[list[str], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the window and the offset of quanta, from names of sources, each quantum's source among these, and its number there.

    A quantum's place is the number of those that fall due before it. Estimates of each queue's part
    of that number are set right by comparing due times, so places are exact.
    """
    queues = sorted(queues, key=lambda q: q._source.encode())
    number = {q._source: k for k, q in enumerate(queues)}
    phase, weight = (np.array([q[c] for q in queues], float) for c in ("_phase", "_weight"))
    quanta = np.array([q._quanta for q in queues], np.int64)
    tail_window, tail_at = (np.array([q[c] or 0 for q in queues], np.int64) for c in ("sequence_id", "_at"))
    per_window = window // quantum

    def places(sources: list[str], row: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.array([number[s] for s in sources], np.int64)[row]
        due = (unit + phase[of]) / weight[of]
        place = np.zeros(len(unit), np.int64)
        for k in range(len(queues)):
            ties = of > k

            def earlier(j: np.ndarray) -> np.ndarray:
                time = (j + phase[k]) / weight[k]
                return (time < due) | (time == due) & ties

            count = np.clip(np.ceil(due * weight[k] - phase[k]), 0, quanta[k]).astype(np.int64)
            while (more := (count < quanta[k]) & earlier(count)).any():
                count += more
            while (less := (count > 0) & ~earlier(count - 1)).any():
                count -= less
            place += count
        tail = unit == quanta[of]
        return np.where(tail, tail_window[of], place // per_window), np.where(tail, tail_at[of], place % per_window * quantum)

    return places


def cut_pieces(placed: DataFrame, quantum: int, kind: str, places: Callable | None = None) -> DataFrame:
    """Cut documents where their source's stream begins a new quantum. With `places`, also put the pieces there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("_first", "_n"))
            unit = first // quantum
            parts = (first + n - 1) // quantum - unit + 1
            row = np.repeat(np.arange(len(n)), parts)
            unit = np.repeat(unit - np.cumsum(parts) + parts, parts) + np.arange(len(row))
            begin = np.maximum(unit * quantum, first[row])
            end = np.minimum((unit + 1) * quantum, (first + n)[row])
            start = begin - first[row]
            blobs = batch.column("_ids")
            crc, at = np.empty(len(row), np.int64), 0
            for k, count in enumerate(parts.tolist()):
                ids = memoryview(blobs[k].as_buffer())
                for j in range(at, at + count):
                    crc[j] = zlib.crc32(ids[4 * start[j] : 4 * (end[j] - begin[j] + start[j])])
                at += count
            inside = begin - unit * quantum
            if places:
                sources = batch.column("_source").dictionary_encode()
                unit, at = places(sources.dictionary.to_pylist(), sources.indices.to_numpy()[row], unit)
                inside = at + inside
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(take), batch.column("_source").take(take), pa.array(unit), pa.array(inside), pa.array(start), pa.array(end - begin), pa.array(crc), pa.array(n[row])],
                names=["_key", "_source", *where, "start", "length", "ids_crc32", "doc_tokens"],
            )

    where = ("sequence_id", "offset") if places else ("_unit", "_in_unit")
    schema = f"_key {kind}, _source string, {where[0]} bigint, {where[1]} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return placed.select("_key", "_source", "_first", "_n", "_ids").mapInArrow(cut, schema)


def pack(
    df: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    window: int = 1024,
    quantum: int = 32,
    targets: dict[str | None, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    rows_per_bin: int = ROWS_PER_BIN,
    most_counted: int = MOST_COUNTED,
) -> DataFrame:
    """Pieces of documents and their places in windows filled by deficit round-robin over the sources' queues.

    Each source's documents form one stream. A source gains credit in proportion to
    its target and sends a quantum of tokens whenever its credit has grown by one: its
    j-th quantum falls due at time (j + u) / target, where u in (0, 1) is a hash of the
    source, so that similar sources don't all fall due together. Quanta go out in the order in
    which they fall due, ties by source, so credit that a window leaves unspent carries over to
    the next one, into whichever partition that falls. What a source has sent by any time is off
    its target by less than a quantum; the length of a window in that time varies with how many others
    happen to fall due. A source that has run out drops out of the round and the
    others go on. Without `targets` a source's target is its share of all tokens, and all
    run out together; sources that `targets` doesn't name get the smallest weight in it.

    As due times are known beforehand, places are counted. With up to `most_counted` sources the
    task that cuts a document does so, from the table of sources and without a shuffle. With more, quanta
    are put in order within bins of due time, after the sums of earlier bins; results are the same.
    What is left of a source below one quantum is packed behind all full quanta, as many as fit in a window.

    Each row's ids are those of `vocabulary` without special tokens, and `end_id`. Null and
    empty texts give the end id alone. Null sources form one queue; repeated rows are packed
    one by one; an empty table gives an empty one. Other columns are left out. `window` must
    be a multiple of `quantum`.
    """
    assert window % quantum == 0 and (not targets or min(targets.values()) > 0)
    kind = dict(df.dtypes)[key]
    streams = cut_lineage(token_streams(df, key, text, source, vocabulary, end_id))
    sums = streams.groupBy("_source", "_part").agg(F.sum("_n").alias("_tokens"))
    parts = Window.partitionBy("_source").orderBy("_part")
    base = cut_lineage(
        sums.select(
            "_source",
            "_part",
            F.coalesce(F.sum("_tokens").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
            F.sum("_tokens").over(Window.partitionBy("_source")).alias("_all"),
        )
    )
    placed = streams.join(base, ["_source", "_part"]).withColumn("_first", F.col("_base") + F.col("_before"))
    queues = base.groupBy("_source").agg(F.first("_all").alias("_all"))
    queues = queues.withColumn("_quanta", F.expr(f"_all div {quantum}")).withColumn("_tail", F.expr(f"_all % {quantum}"))
    if targets:
        weight = F.lit(float(min(targets.values())))
        for name, value in targets.items():
            named = F.lit("-") if name is None else F.lit(f"{len(name)}={name}")
            weight = F.when(F.col("_source") == named, F.lit(float(value))).otherwise(weight)
    else:
        weight = F.greatest(F.col("_quanta"), F.lit(1)).cast("double")
    phase = (F.conv(F.substring(seeded_order("pack", "_source"), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**32)
    queues = cut_lineage(queues.withColumn("_weight", weight).withColumn("_phase", phase))
    total = queues.agg(F.count("*").alias("queues"), F.sum("_quanta").alias("quanta"), F.max(F.col("_quanta") / F.col("_weight")).alias("last"), F.sum("_weight").alias("weights")).first()
    quanta, last = total["quanta"] or 0, total["last"] or 1.0
    per_window = window // quantum
    tails = queues.filter(F.col("_tail") > 0).withColumn("_bin", F.pmod(F.xxhash64("_source"), F.lit(bins_for(total["queues"], rows_per_bin))))
    tails = running(tails.withColumn("_zero", F.lit(0)), [], "_bin", ["_source"], F.col("_tail"), "_begin", "_sum")
    room = window - quantum + 1
    tails = tails.withColumn("_slot", F.expr(f"_begin div {room}"))
    tails = tails.select(
        "_source",
        F.col("_quanta").alias("_unit"),
        (F.col("_slot") + F.lit(-(-quanta // per_window))).alias("sequence_id"),
        (F.col("_begin") - F.min("_begin").over(Window.partitionBy("_slot"))).alias("_at"),
    )
    if total["queues"] <= most_counted:
        rows = queues.join(tails.drop("_unit"), "_source", "left").collect()
        found = cut_pieces(placed, quantum, kind, counted_places(rows, window, quantum))
        return found.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("_source").alias("queue"))
    # At most `weights` quanta fall due in a unit of time, so no bin holds many more than rows_per_bin.
    bins = max(bins_for(quanta, rows_per_bin), int((total["weights"] or 0) * last / rows_per_bin) + 1)

    cuts = cut_lineage(cut_pieces(placed, quantum, kind))
    units = cuts.filter(F.col("_in_unit") == 0).select("_source", "_unit").join(queues, "_source").filter(F.col("_unit") < F.col("_quanta"))
    units = units.withColumn("_due", (F.col("_unit") + F.col("_phase")) / F.col("_weight")).withColumn("_bin", F.floor(F.col("_due") / F.lit(last) * bins))
    units = running(units.select("_source", "_unit", "_due", "_bin"), [], "_bin", ["_due", "_source"], F.lit(1).cast("long"), "_place", "_count")
    units = units.select(
        "_source", "_unit", F.expr(f"_place div {per_window}").alias("sequence_id"), F.expr(f"_place % {per_window} * {quantum}").alias("_at")
    )
    found = cuts.join(units.unionByName(tails), ["_source", "_unit"])
    return found.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.col("_at") + F.col("_in_unit")).alias("offset"), F.col("_source").alias("queue"))
