"""Quality rules: counts that reject, and a log-likelihood ratio of hashed n-grams that decides the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from sievelake.llm.common import fresh
from sievelake.llm.words import Words, gram_hashes, pieces, text_bytes, words_of

#: Buckets of the hashed words and word pairs; the model is two counts for each.
BUCKET_BITS = 16
#: Trusted documents that are used at most, by the smallest hashes of their keys.
TRUSTED_ROWS = 200_000
#: Log ratios are whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1 << 20
#: Added to a bucket's target count and to the count expected there, so that rare n-grams decide little.
PRIOR_COUNT = 4
#: A text's summed log ratio is divided by its n-grams plus this number, so that a few words decide little.
PRIOR_GRAMS = 20
#: Texts whose normalised ratio is below this many nats are rejected.
THRESHOLD = -0.15

WINDOW = 5
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*MEASURES, "base_failed", "ratio", "kept"]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and where each text's begin."""
    pairs, first = gram_hashes(words, 2)
    at = np.searchsorted(first, words.of_doc)
    buckets = (np.concatenate([words.hash, pairs]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    place = np.argsort(np.concatenate([np.arange(len(words.hash)), first]), kind="stable")
    return buckets[place], words.of_doc + at


def count_grams(docs: DataFrame) -> DataFrame:
    """Counts of each bucket over all rows (_text, _trusted), and over the trusted ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in pieces(batches, "_text"):
            buckets, at = grams(words_of(*text_bytes(batch.column("_text"))))
            raw += np.bincount(buckets, minlength=len(raw))
            chosen = np.repeat(batch.column("_trusted").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            target += np.bincount(buckets[chosen], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    each = docs.mapInArrow(work, "bucket bigint, raw bigint, target bigint")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log of each bucket's target count over what the raw shares make expect; the driver gets 2^BUCKET_BITS rows at most.

    Without a trusted text all ratios are 0.
    """
    raw, target = np.zeros((2, 1 << BUCKET_BITS))
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.rint(np.log((target + PRIOR_COUNT) / (expected + PRIOR_COUNT)) * SCALE).astype(np.int64)


def repeated_words(text: bytes, repeated: np.ndarray, n: int) -> int:
    """Words in runs of five that are found twice, given where their hashes are."""
    words, seen = text.split(), {}
    for at in repeated.tolist():
        seen.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    inside = np.zeros(n + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for at in places:
                inside[at] += 1
                inside[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(inside)[:n]))


def measure(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    def total(per_byte: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8)
    runs, first = gram_hashes(words, WINDOW, 14)
    at = np.searchsorted(first, words.of_doc)
    lines, repeats = [], []
    n_words = np.diff(words.of_doc)
    for k in range(len(offsets) - 1):
        text = data[offsets[k] : offsets[k + 1]].tobytes()
        full = [line for line in text.split(b"\n") if line and not line.isspace()]
        lines.append(len(full) - len(set(full)))
        own = runs[at[k] : at[k + 1]]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            repeats.append(0)
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeats.append(repeated_words(text, np.flatnonzero(twice), int(n_words[k])))
    return {
        "n_words": n_words,
        "word_chars": total(in_word * ((data & 0xC0) != 0x80)),
        "n_symbols": total(SYMBOLS[data]),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": np.array(repeats, np.int64),
    }


def quality_rules(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add counts, `base_failed`, `ratio` (in 1 / SCALE nats per n-gram) and `kept` to every row.

    Words and word pairs are hashed into buckets. The raw multinomial counts them in all rows, the
    target multinomial in the rows whose keys `trusted` (one column) holds; of more than TRUSTED_ROWS
    trusted keys, those with the smallest hashes are used, so the broadcast is bounded. A row's ratio is the
    summed log(target / raw) of its n-grams over their number plus PRIOR_GRAMS. Rows below
    `threshold` are rejected, as are those with under 10 words or over a fifth of their words in
    repeated runs of five.

    Null and empty texts have no words and fail. Repeated rows are each measured, and counted each time.
    Null keys are never trusted. Without trusted rows every ratio is 0. An empty table gives an empty
    one. Columns of `df` are carried along, those named like the added ones are replaced.
    """
    carried = [f for f in df.schema.fields if f.name not in ADDED]
    chosen = trusted.select(F.col(trusted.columns[0]).alias("_key")).filter("_key IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(TRUSTED_ROWS).withColumn("_hit", F.lit(True))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    marked = rows.join(F.broadcast(chosen), "_key", "left").select("_text", F.col("_hit").isNotNull().alias("_trusted"))
    ratios = df.sparkSession.sparkContext.broadcast(log_ratios(count_grams(marked)))
    least = round(threshold * SCALE)

    own = fresh(df, "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own):
            data, offsets = text_bytes(batch.column(own))
            words = words_of(data, offsets)
            found = measure(data, offsets, words)
            buckets, at = grams(words)
            sums = np.concatenate([[0], np.cumsum(ratios.value[buckets])])
            weight = np.diff(at) + PRIOR_GRAMS
            ratio = (sums[at[1:]] - sums[at[:-1]]) // weight
            n = found["n_words"]
            failed = (n < 10) | (100 * found["n_repeat_words"] > 20 * n)
            kept = ~failed & (ratio >= least)
            columns = [batch.column(f.name) for f in carried] + [pa.array(found[m]) for m in MEASURES] + [pa.array(failed), pa.array(ratio), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in carried], *ADDED])

    counts = [StructField(c, BooleanType() if c in ("base_failed", "kept") else LongType()) for c in ADDED]
    whole = df.select(*[F.col(f"`{f.name}`") for f in carried], F.col(f"`{text}`").alias(own))
    return whole.mapInArrow(work, StructType([*carried, *counts]))
