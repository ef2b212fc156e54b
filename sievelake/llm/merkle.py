"""Merkle manifest of a table: one tree for each group, one over their roots, and a recursive climb that checks every row.

A node is the SHA-256 of its children's digests as hex text; children come in runs of two, and a last run of one is hashed
alone. A tree of one node is that node. Levels are built twelve at a time: a task takes a run of 4096 nodes, in order, and
stores for each of them the siblings on its way up to the top of the run. So the stored node rows are the tops of runs, each
linked to its parent; a recursive query starts at every leaf and goes from parent to parent, appending the siblings it passes
and folding the digest it was given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import fresh, group_key, running
from sievelake.session import cut_lineage, forget

#: Levels between a stored node and its parent; a run has 2 ** LEVELS nodes at most.
LEVELS = 12
RUN = 1 << LEVELS
#: A step of a path is the side of the sibling (none, left, right) and its digest.
STEP = 33
NONE, LEFT, RIGHT = 0, 1, 2


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 (binary) over the columns in turn: `-` for null, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def height(nodes: int) -> int:
    """Levels of runs of two until one node is left."""
    return max(0, int(nodes) - 1).bit_length()


def climb_run(digests: np.ndarray, levels: int) -> tuple[np.ndarray, bytes]:
    """The way up of each node of a run (nodes, levels, STEP), and the digest at its top."""
    n = len(digests)
    paths = np.zeros((n, levels, STEP), np.uint8)
    place, row = np.arange(n), digests
    for level in range(levels):
        other = place ^ 1
        there = other < len(row)
        side = np.where(other < place, LEFT, RIGHT)
        paths[there, level, 0] = side[there]
        paths[there, level, 1:] = row[other[there]]
        texts = [bytes(d).hex().encode() for d in row]
        above = [hashlib.sha256(b"".join(texts[k : k + 2])).digest() for k in range(0, len(texts), 2)]
        row, place = np.frombuffer(b"".join(above), np.uint8).reshape(-1, 32), place >> 1
    return paths, bytes(row[0])


def _climb_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and place, with the path to the top of their run; the first row of a run also has its digest."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        digests = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        paths, top = climb_run(digests, min(LEVELS, height(table["nodes"][0].as_py())))
        table = table.append_column("path", pa.array([p.tobytes() for p in paths], pa.binary()))
        table = table.append_column("top", pa.array([top] + [None] * (table.num_rows - 1), pa.binary()))
        yield from table.to_batches()

    def same(a, i, b, j):
        return a["tree"][i] == b["tree"][j] and a["run"][i] == b["run"][j]

    for batch in batches:
        at = 0
        trees, runs = batch["tree"].to_numpy(zero_copy_only=False), batch["run"].to_numpy()
        cuts = np.flatnonzero((trees[1:] != trees[:-1]) | (runs[1:] != runs[:-1])) + 1
        for to in [*cuts.tolist(), batch.num_rows]:
            if to > at:
                if held and not same(held[0], 0, batch, at):
                    yield from done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, to - at))
                at = to
    if held:
        yield from done(pa.Table.from_batches(held))


def _with_runs(nodes: DataFrame) -> DataFrame:
    """nodes: tree, place, nodes (of this tree on this level), digest and more. Adds run, path and top; written and read back."""
    marked = nodes.withColumn("run", F.shiftright("place", LEVELS))
    spread = marked.repartition("tree", "run").sortWithinPartitions("tree", "place")
    types = {f.name: f.dataType.simpleString() for f in spread.schema.fields} | {"path": "binary", "top": "binary"}
    return cut_lineage(spread.mapInArrow(_climb_runs, ", ".join(f"`{c}` {t}" for c, t in types.items())))


def _placed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with their place in the group's order and the group's size, counted range by range.

    Ranges are written with the rows, so a repeated task finds the same ones.
    """
    ranges = cut_lineage(rows.repartitionByRange(*groups, *order).withColumn("range", F.spark_partition_id()))
    return running(ranges, groups, "range", order, F.lit(1).cast("long"), "place", "nodes").drop("range")


def _tops(level: DataFrame) -> DataFrame:
    return level.filter("top IS NOT NULL").select("tree", F.col("run").alias("place"), F.col("top").alias("digest"), F.shiftright(F.col("nodes") + (RUN - 1), LEVELS).alias("nodes"))


def _levels(bottom: DataFrame) -> list[DataFrame]:
    """The stored rows of every tier, from the bottom to the one of single runs."""
    tiers = [_with_runs(bottom)]
    while (tiers[-1].agg(F.max("nodes")).first()[0] or 0) > RUN:
        tiers.append(_with_runs(_tops(tiers[-1])))
    return tiers


def build(leaves: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame, bytes | None, int, int]:
    """Trees over `leaves` (digest, a group and an order column, and others).

    Returns the leaf rows with tree, run and path; the rows of stored nodes; the root; the tier of the subroots; the last tier.
    Node rows: tree, tier, place, parent, digest, path. A node is stored once for each run of leaves below it (`copy`), which
    makes at most 1 row for 4096 leaves and tier, so that no node's row meets more than 4096 leaves. Equal order values are
    taken in order of digests; null comes first. An empty table has no root.
    """
    tree = group_key(group)
    placed = _placed(cut_lineage(leaves.withColumn("tree", tree)), ["tree"], [order, "digest"])
    own = _levels(placed)
    bottom = own[0]
    if bottom.isEmpty():
        return bottom, bottom, None, 0, 0
    subroots = own[-1].filter("top IS NOT NULL").select("tree", F.col("top").alias("digest"))
    named = bottom.filter("place = 0").select("tree", F.col(group).alias("_name"))
    over = _placed(subroots.join(named, "tree").select(F.lit("").alias("tree"), F.col("tree").alias("below"), "_name", "digest"), ["tree"], ["_name"])
    top = _levels(over)
    root = bytes(top[-1].filter("top IS NOT NULL").first()["top"])
    first, copies = len(own), bottom.filter("top IS NOT NULL").select("tree", F.col("run").alias("copy"))
    of_tree = top[0].select(F.col("below").alias("tree"), F.col("place").alias("subplace"))
    stored = []
    for k, tier in enumerate(own[1:], 1):
        rows = tier.select("tree", F.lit(k).alias("tier"), "place", F.col("run").alias("parent"), "digest", "path")
        stored.append(_spread(rows, copies.withColumn("place", F.shiftright("copy", LEVELS * (k - 1))), ["tree", "place"]))
    for k, tier in enumerate(top):
        rows = tier.select(F.lit(first + k).alias("tier"), F.col("place").alias("subplace"), F.col("run").alias("parent"), "digest", "path")
        at = copies.join(of_tree, "tree").withColumn("subplace", F.shiftright("subplace", LEVELS * k))
        stored.append(_spread(rows, at, ["subplace"]).withColumnRenamed("subplace", "place"))
    nodes = stored[0]
    for more in stored[1:]:
        nodes = nodes.unionByName(more)
    return bottom, cut_lineage(nodes), root, first, first + len(top) - 1


def _spread(rows: DataFrame, copies: DataFrame, on: list[str]) -> DataFrame:
    return copies.join(rows, on)


def _fold(digest: str, path: str) -> str:
    """SQL: the digest after all steps of a path."""
    step = f"substring({path}, k * {STEP} + 1, 1)"
    sibling = f"lower(hex(substring({path}, k * {STEP} + 2, {STEP - 1})))"
    text = f"CASE {step} WHEN X'01' THEN concat({sibling}, lower(hex(h))) WHEN X'02' THEN concat(lower(hex(h)), {sibling}) ELSE lower(hex(h)) END"
    return f"CASE WHEN octet_length({path}) = 0 THEN {digest} ELSE aggregate(sequence(0, octet_length({path}) div {STEP} - 1), {digest}, (h, k) -> unhex(sha2({text}, 256))) END"


def proof_text(path: Column) -> Column:
    """The siblings of a path as hex text, end to end."""
    steps = F.when(F.octet_length(path) > 0, F.sequence(F.lit(0), (F.octet_length(path) / STEP).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    sibling = lambda k: F.when(F.substr(path, k * STEP + 1, F.lit(1)) == F.lit(bytes([NONE])), F.lit("")).otherwise(F.lower(F.hex(F.substr(path, k * STEP + 2, F.lit(STEP - 1)))))
    return F.concat_ws("", F.transform(steps, sibling))


def verify(leaves: DataFrame, group: str, order: str, given: str) -> DataFrame:
    """Every leaf row climbs to the root, with the digest in column `given` instead of its own `digest`.

    Returns the columns of `leaves` with subroot, root, folded (binary) and path (all steps). Repeated rows climb each for
    themselves; an empty table gives no rows. Own columns with the names that are used here keep their values under them,
    unless they are among the four returned names.
    """
    spark = leaves.sparkSession
    used = ["tree", "range", "place", "nodes", "run", "top", "path", "_name", "subroot", "root", "folded", "tier", "parent", "copy", "start", "below", "subplace"]
    renamed = {c: fresh(leaves, f"own_{c.lower()}") for c in leaves.columns if c.lower() in used}
    plain = leaves.withColumnsRenamed(renamed)
    bottom, nodes, root, first, last = build(plain, renamed.get(group, group), renamed.get(order, order))
    back = [F.col(renamed.get(c, c)).alias(c) for c in leaves.columns if c not in ("subroot", "root", "folded", "path")]
    if root is None:
        return plain.limit(0).select(*back, *[F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "folded", "path")])
    own = ", ".join(f"`{renamed.get(c, c)}`" for c in leaves.columns)
    carried = ", ".join(f"c.`{renamed.get(c, c)}`" for c in leaves.columns)
    query = f"""
    WITH RECURSIVE climb AS (
      SELECT {own}, tree, run AS copy, 0 AS tier, run AS parent, CAST(NULL AS BINARY) AS subroot, path,
             {_fold(f"`{renamed.get(given, given)}`", "path")} AS folded
      FROM {{leaves}}
      UNION ALL
      SELECT {carried}, c.tree, c.copy, n.tier, n.parent, CASE WHEN n.tier = {first} THEN n.digest ELSE c.subroot END, concat(c.path, n.path),
             {_fold("c.folded", "n.path")}
      FROM climb c JOIN {{nodes}} n
        ON n.tree = c.tree AND n.copy = c.copy AND n.tier = c.tier + 1 AND (n.place = c.parent OR n.tier = {first})
    )
    SELECT * FROM climb WHERE tier = {last}
    """
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the limit guards against endless recursion; this one ends at the last tier
    try:
        climbed = cut_lineage(spark.sql(query, leaves=bottom, nodes=nodes))
    finally:
        spark.conf.set(limit, before)
    forget(bottom, nodes)
    return climbed.select(*back, "subroot", F.lit(root).alias("root"), "folded", "path")
