"""Token ids of documents as files of coded blocks, in key order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.idcoder import decode_ids, encode_ids
from sievelake.llm.tokens import BATCH_BYTES, encoder, with_end
from sievelake.llm.words import pieces, text_bytes

#: A segment ends with the document that reaches this number of ids; a task's last one may have half as many more.
SEGMENT_IDS = 5_000_000


def id_segments(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Segments of consecutive documents in ascending key order, to be written as a table.

    Each row of the result is a segment: `part` and `segment` say where it stands, `keys` and `lengths`
    list its documents, and `coded` holds all their ids in blocks that are coded, reset and checked on their
    own. A document's ids are the vocabulary's, without special tokens, and end_id. Keys are dealt to parts by
    range; rows with the same key are ordered by text. Null keys come first, null texts are empty.
    An empty table gives no segments. Vocabularies may have 65,536 ids.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    dealt = rows.repartitionByRange(partitions, "_key", "_tie") if partitions else rows.repartitionByRange("_key", "_tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, done = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys, lengths, ids, count = [], [], [], 0

        def segment(most: int) -> pa.RecordBatch:
            """The next segment; the document that reaches `most` ids is its last. What is left stays gathered."""
            nonlocal keys, lengths, ids, count, done
            key_list, sizes, plain = pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(ids)
            ends = np.cumsum(sizes)
            cut = min(len(sizes), int(np.searchsorted(ends, most)) + 1)
            end = int(ends[cut - 1])
            keys, lengths, ids, count = [key_list[cut:]], [sizes[cut:]], [plain[end:]], len(plain) - end
            done += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([done - 1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, cut], pa.int32()), key_list[:cut]),
                    pa.array([sizes[:cut]], pa.list_(pa.int64())),
                    pa.array([encode_ids(plain[:end])], pa.binary()),
                ],
                names=["part", "segment", "keys", "lengths", "coded"],
            )

        for batch in pieces(batches, "_text", BATCH_BYTES):
            got, at = with_end(*tokens.encode_bytes(*text_bytes(batch.column("_text"))), end_id)
            keys.append(batch.column("_key"))
            lengths.append(np.diff(at))
            ids.append(got)
            count += len(got)
            # The last segment keeps at least half: short ones take the coder as many steps as long ones.
            while count >= SEGMENT_IDS + SEGMENT_IDS // 2:
                yield segment(SEGMENT_IDS)
        if count:
            yield segment(count)

    return dealt.sortWithinPartitions("_key", "_tie").select("_key", "_text").mapInArrow(work, f"part int, segment int, keys array<{kind}>, lengths array<bigint>, coded binary")


def read_ids(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's key, `start` (ids of all documents before it), `n_tokens` and `ids_crc32`, decoded from the segments.

    Blocks are checked; damaged ones raise ValueError.
    """
    kind = dict(segments.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    sums = segments.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    # A row for each segment of millions of ids; parts are added up first and put in order alone.
    parts = sums.groupBy("part").agg(F.sum("_n").alias("_all"))
    parts = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.withColumn("_inside", inside).join(parts, "part").select("part", "segment", (F.col("_base") + F.col("_inside")).alias("_first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_ids(batch.column("coded")[k].as_py()).astype("<u4")
                lengths = batch.column("lengths")[k].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(lengths)])
                if at[-1] != len(ids):
                    raise ValueError("lengths don't match the ids")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[k].values, pa.array(at[:-1] + batch.column("_first")[k].as_py()), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "segment", "keys", "lengths", "coded").join(places, ["part", "segment"])
    return found.select("keys", "lengths", "coded", "_first").mapInArrow(work, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
