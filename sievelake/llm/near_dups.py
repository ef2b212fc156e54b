"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.components import components
from sievelake.llm.words import gram_hashes, mix64, pieces, run_hash, running_hash, seeds, text_bytes, words_of
from sievelake.session import cut_lineage

#: Signature length and rows of a band: a pair at similarity 0.8 shares no band with probability 5e-8.
HASHES, BAND_ROWS = 128, 4
#: Hashes compared between two looks at the posterior, and the probability below which a pair is dropped.
BATCH, MISS = 32, 1e-7
#: Nodes that one task compares with as many others at once.
BLOCK = 256


def shingle_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, sorted, end to end, and where each text's begin."""
    data, offsets = text_bytes(batch.column("_text"))
    words = words_of(data + np.uint8(32) * ((data >= 65) & (data <= 90)), offsets)
    grams, first = gram_hashes(words, n)
    at = np.searchsorted(first, words.of_doc)
    short = np.flatnonzero((np.diff(words.of_doc) > 0) & (np.diff(at) == 0))
    whole = dict(zip(short.tolist(), run_hash(running_hash(words.hash, 13), words.of_doc[short], words.of_doc[short + 1], 13), strict=True))
    sets = [np.array([whole[k]], np.uint64) if k in whole else np.unique(grams[at[k] : at[k + 1]]) for k in range(batch.num_rows)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """Set size, a 128-bit name of the set, MinHash signature and band keys of each row (_key, _text)."""
    factors = seeds(21, HASHES) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            grams, at = shingle_sets(batch, n)
            some = at[1:] > at[:-1]
            starts = at[:-1][some]
            name = np.zeros((2, batch.num_rows), np.uint64)
            sig = np.zeros((batch.num_rows, HASHES), np.uint32)
            if len(starts):
                for k, seed in enumerate((31, 32)):
                    name[k, some] = np.add.reduceat(mix64(grams ^ seeds(seed, 1)[0]), starts)
                low = np.stack([np.minimum.reduceat(grams * f, starts) for f in factors], 1)
                sig[some] = (low >> np.uint64(32)).astype(np.uint32)
            rows_of = sig.reshape(batch.num_rows, -1, BAND_ROWS).astype(np.uint64)
            keys = np.arange(1, HASHES // BAND_ROWS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for j in range(BAND_ROWS):
                keys = mix64(keys ^ rows_of[:, :, j])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            blobs = pa.array([s.tobytes() for s in sig], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.diff(at)), pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)), blobs, bands],
                names=["_key", "n", "_set_1", "_set_2", "sig", "bands"],
            )

    return rows.mapInArrow(work, f"_key {kind}, n bigint, _set_1 bigint, _set_2 bigint, sig binary, bands array<bigint>")


def shingles_of(rows: DataFrame, n: int, kind: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            grams, at = shingle_sets(batch, n)
            lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(grams.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], names=["node", "shingles"])

    return rows.mapInArrow(work, f"node {kind}, shingles array<bigint>")


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches at which similarity >= percent still has posterior `miss` (uniform prior)."""
    out, p = [], percent / 100
    for seen in range(BATCH, HASHES + 1, BATCH):
        below = 0.0
        for m in range(seen + 1):
            below += comb(seen + 1, m) * p**m * (1 - p) ** (seen + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return out


def verify(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough.

    Signatures are compared in batches; a pair is dropped as soon as the posterior
    probability of enough similarity is below MISS. What is left is decided on the full sets.
    """
    needed = least_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = np.arange(batch.num_rows)
            sigs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
            matches = np.zeros(batch.num_rows, np.int64)
            for step, least in enumerate(needed):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (sigs[0][alive, part] == sigs[1][alive, part]).sum(1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                one, two = (batch.column(c)[k].values.to_numpy() for c in ("set_a", "set_b"))
                both = len(np.intersect1d(one, two))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = {x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    found = pairs.join(side["a"], "a").join(side["b"], "b")
    found = found.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "sig_a", "sig_b")
    left = cut_lineage(found.mapInArrow(prune, f"a {kind}, b {kind}"))
    whole = {x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    full = left.join(whole["a"], "a").join(whole["b"], "b").select("a", "b", "set_a", "set_b")
    return cut_lineage(full.mapInArrow(exact, f"a {kind}, b {kind}").distinct())


def overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set in `one` with every set in `two`, as products of 0/1 matrices."""
    items, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    out = np.zeros((len(one), len(two)), np.int64)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for at in range(0, len(items), columns):
        part = slice(*np.searchsorted(place, [at, at + columns]))
        grid = np.zeros((len(one) + len(two), columns), np.float32)
        grid[row[part], place[part] - at] = 1
        out += (grid[: len(one)] @ grid[len(one) :].T).astype(np.int64)
    return out


def leftover_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links across labels among nodes whose bands share a hub, other than the hub's own.

    The nodes of a hub are dealt to blocks of about BLOCK nodes, large labels to blocks of their own; two blocks
    make one row, unless they are of one label. Inside, signatures are compared in batches, pairs are dropped
    by their posterior, and what is left is decided on the full sets. So only links leave a task.
    """
    needed = least_matches(percent)
    pools = members.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("pool"), "node").distinct()
    named = pools.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = cut_lineage(named.groupBy("pool", "label").agg(F.count(F.lit(1)).alias("_nodes")))
    large = F.col("_nodes") >= BLOCK // 2
    whole = counts.groupBy("pool").agg(F.count(F.lit(1)).alias("_labels"), F.sum(F.when(~large, F.col("_nodes"))).alias("_small")).filter("_labels > 1")
    sized = counts.join(whole, "pool").withColumn("_own", F.when(large, F.col("label")))
    sized = sized.withColumn("_parts", F.ceil(F.when(large, F.col("_nodes")).otherwise(F.col("_small")) / BLOCK))
    dealt = named.join(sized.select("pool", "label", "_own", "_parts"), ["pool", "label"])
    block = F.concat(F.coalesce(F.col("_own").cast("string"), F.lit("-")), F.lit(":"), F.pmod(F.xxhash64("node"), F.col("_parts")).cast("string"))
    dealt = cut_lineage(dealt.select("pool", "node", "label", "_own", block.alias("block")))
    names = dealt.select("pool", "block", "_own").distinct()
    left, right = (names.select("pool", F.col("block").alias(f"block_{x}"), F.col("_own").alias(f"own_{x}")) for x in "ab")
    pairs = left.join(right, "pool").filter("block_a <= block_b AND NOT coalesce(own_a = own_b, false)").select("pool", "block_a", "block_b")
    full = dealt.join(nodes.select("node", "sig"), "node").join(sets, "node")
    packed = cut_lineage(full.groupBy("pool", "block").agg(F.collect_list(F.struct("node", "label", "sig", "shingles")).alias("held")))
    one, two = (packed.select("pool", F.col("block").alias(f"block_{x}"), F.col("held").alias(f"held_{x}")) for x in "ab")
    rows = pairs.join(one, ["pool", "block_a"]).join(two, ["pool", "block_b"]).select((F.col("block_a") == F.col("block_b")).alias("same"), "held_a", "held_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = [batch.column(c)[k].values for c in ("held_a", "held_b")]
                node, label = ([h.field(c) for h in held] for c in ("node", "label"))
                label = np.unique(pa.concat_arrays(label).to_numpy(zero_copy_only=False), return_inverse=True)[1]
                n = len(held[0])
                sig = [np.frombuffer(b"".join(h.field("sig").to_pylist()), np.uint32).reshape(-1, HASHES) for h in held]
                lists = [h.field("shingles") for h in held]
                size = [np.diff(x.offsets.to_numpy()) for x in lists]
                alive = label[:n, None] != label[None, n:]
                alive &= np.minimum(size[0][:, None], size[1]) * 100 >= np.maximum(size[0][:, None], size[1]) * percent
                if batch.column("same")[k].as_py():
                    alive = np.triu(alive)
                a, b = alive.nonzero()
                matches = np.zeros(len(a), np.int64)
                for step, least in enumerate(needed):
                    part = slice(step * BATCH, (step + 1) * BATCH)
                    matches += (sig[0][a, part] == sig[1][b, part]).sum(1)
                    good = matches >= least
                    a, b, matches = a[good], b[good], matches[good]
                if not len(a):
                    continue
                (rows_a, at_a), (rows_b, at_b) = (np.unique(x, return_inverse=True) for x in (a, b))
                both = overlaps([lists[0][i].values.to_numpy() for i in rows_a.tolist()], [lists[1][i].values.to_numpy() for i in rows_b.tolist()])[at_a, at_b]
                good = 100 * both >= percent * (size[0][a] + size[1][b] - both)
                yield pa.RecordBatch.from_arrays([node[0].take(pa.array(a[good])), node[1].take(pa.array(b[good]))], names=["a", "b"])

    return cut_lineage(rows.mapInArrow(compare, f"a {kind}, b {kind}").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """`n_shingles`, `component_id` and `kept` of each row, with its key.

    A row's set are the distinct runs of `shingle` words of its lower-cased (A-Z) text;
    a shorter text is one run. Rows whose sets have 100 * intersection >= percent * union
    are linked, and linked rows share the smallest key that can be reached; the row with
    that key is kept.

    Equal sets are one node from the start, so exact copies cost one row each. Nodes that
    share a band of their MinHash signatures are candidates. First each is compared with the
    smallest node of its bands; then, where the nodes of one such hub are still several components,
    those are compared across components, block by block, so no link is given up and no
    pair becomes a row before it is a link. Sequential Bayesian tests on signature batches drop
    hopeless pairs; the rest is decided on the full sets.

    Null, empty and blank texts have no shingles, are linked with nothing and kept. Rows with a
    null key are not compared; their component_id is null and kept is true. Rows that share
    a key count as one document. An empty table gives an empty one. Other columns are left out.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    all_rows = cut_lineage(sketch(rows, shingle, kind).withColumn("_row", F.monotonically_increasing_id()))
    usable = all_rows.filter(F.col("_key").isNotNull() & (F.col("n") > 0))
    firsts = usable.groupBy("_set_1", "_set_2", "n").agg(F.min(F.struct("_key", "_row")).alias("_first"))
    classes = cut_lineage(firsts.select("_set_1", "_set_2", "n", F.col("_first._key").alias("node"), F.col("_first._row").alias("_row")))
    nodes = cut_lineage(all_rows.select("_row", "sig", "bands").join(classes.select("_row", "node", "n"), "_row").select("node", "n", "sig", "bands"))

    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).filter(F.col("hub") != F.col("_last")).select("band", "hub")
    members = cut_lineage(bands.join(shared, "band"))
    wanted = cut_lineage(members.select("node").distinct())
    texts = rows.join(wanted.withColumnRenamed("node", "_key"), "_key", "left_semi")
    sets = cut_lineage(shingles_of(texts, shingle, kind))
    signatures = cut_lineage(nodes.join(wanted, "node", "left_semi").select("node", "n", "sig"))
    stars = members.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verify(stars, signatures, sets, percent, kind)
    more = leftover_links(members, signatures, sets, components(links), percent, kind)
    labels = components(links.unionByName(more))

    named = classes.join(labels, "node", "left").select("_set_1", "_set_2", "n", F.coalesce("label", "node").alias("_component"))
    out = all_rows.select("_key", "n", "_set_1", "_set_2").join(named, ["_set_1", "_set_2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("_key").isNotNull(), F.col("_component"))).otherwise(F.col("_key"))
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))
    )
