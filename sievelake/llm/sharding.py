"""Proportional stratified interleaving of sources into shards (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import ROWS_PER_BIN, bins_for, group_key, hash_bin, running, seeded_order



def interleave(
    df: DataFrame, key: str = "doc_id", source: str = "source", n_shards: int = 24, seed: str = "shards", rows_per_bin: int = ROWS_PER_BIN
) -> DataFrame:
    """Add `shard` and `slot` so that every shard has the sources' proportions.

    Rows of a source are shuffled by a seeded hash of `key` and ranked r = 1..n;
    all rows are then sorted by (r - 0.5) / n, and the line is cut into shards
    whose row counts differ by one at most. A source has between floor and ceil
    of its share, give or take one, in each shard. `slot` counts from 0 in a shard.

    Null keys and sources are values like any other, repeated rows are placed one
    by one, ties of the hash go by key, and of fractions by source. An empty table
    gives an empty one. Columns that are already named `shard` or `slot` are replaced.
    Any column may be null; other columns are carried along.
    """
    bins = bins_for(df.count(), rows_per_bin)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{key}`").alias("_key"), group_key(source).alias("_source"))
    rows = rows.withColumn("_hash", seeded_order(seed, "_key"))
    rows = rows.withColumn("_bin", hash_bin(F.col("_hash"), bins))
    ranked = running(rows, ["_source"], "_bin", ["_hash", "_key"], F.lit(1).cast("long"), "_rank", "_source_rows")
    lined = ranked.withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_source_rows")).drop("_bin")
    lined = lined.withColumn("_bin", F.floor(F.col("_fraction") * bins))
    placed = running(lined, [], "_bin", ["_fraction", "_source", "_hash", "_key"], F.lit(1).cast("long"), "_place", "_rows")
    placed = placed.withColumn("shard", F.expr(f"_place * {n_shards} div _rows"))
    first = F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}")
    return placed.select("_row.*", F.col("shard").cast("int").alias("shard"), (F.col("_place") - first).alias("slot"))
