"""Patterns for work on groups of any size.

A group may hold a large share of all rows, so nothing here gathers one: group
facts come from aggregates with map-side combine and are joined back by key
without sending a hot key's rows to one task, and neighbourhood windows run on
blocks of bounded length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "_rows"
# A key with more rows than this is hot, if it is among the HOT_KEYS largest. Any other key holds less than
# 1 / HOT_KEYS of all rows, or few rows anyway. A hot key's rows go to SLOTS places, and its facts to each of them.
HOT_ROWS, HOT_KEYS, SLOTS = 1_000_000, 1000, 64
# Keys that a sketch of the largest ones follows.
TRACKED_KEYS = 16_384


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def key_hash(names: list[str]) -> Column:
    return F.xxhash64(F.lit("key"), *[F.col(n) for n in names])


def _row_slot(df: DataFrame) -> Column:
    """A slot that differs between rows of a key and is the same on every attempt of a task."""
    plain = [name for name, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(F.lit("row"), *[F.col(c) for c in plain]), F.lit(SLOTS)).cast("int")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> Column:
    """Hashes of the hot keys of `df`, at most HOT_KEYS of them, as one value.

    A frequent-items sketch reads the key columns only; sketches of tasks merge, so nothing is shuffled but
    them. Its counts are estimates, which decide where rows go and never what comes out.
    """
    hashed = df.select(key_hash(keys).alias("_hash"))
    sketch = hashed.agg(F.expr(f"approx_top_k(_hash, {HOT_KEYS}, {TRACKED_KEYS})").alias("_top"))
    large = F.filter("_top", lambda t: t["count"] > hot_rows)
    return F.coalesce(sketch.select(F.transform(large, lambda t: t["item"])).scalar(), F.array().cast("array<bigint>"))


def counted_hot_keys(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> Column:
    """The same from a table that has every key with its number of rows."""
    largest = counts.filter(F.col(ROWS) > hot_rows).select(key_hash(keys).alias("_hash"), ROWS).orderBy(F.desc(ROWS)).limit(HOT_KEYS)
    return F.coalesce(largest.agg(F.collect_list("_hash")).scalar(), F.array().cast("array<bigint>"))


def salted_join(df: DataFrame, lookup: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Left join one row per key. Null keys count as one key.

    Rows of hot keys are dealt to slots by a hash of the whole row and the key's lookup row is copied to each slot; all
    others meet in slot 0. The copies are at most HOT_KEYS * SLOTS short rows. Which side is sent where is left to Spark.
    """
    names = [c for c in lookup.columns if c not in (*keys, ROWS)]
    is_hot = F.array_contains(hot, key_hash(keys))
    marked = df.withColumn("_slot", F.when(is_hot, _row_slot(df)).otherwise(F.lit(0)))
    slots = F.when(is_hot, F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    offered = lookup.select(
        *[F.col(k).alias(f"_f_{k}") for k in keys], F.struct(*names).alias("_facts"), F.explode(slots).alias("_f_slot")
    )
    joined = marked.join(offered, (F.col("_slot") == F.col("_f_slot")) & _same(keys, "_f_"), "left")
    return joined.select(*df.columns, *[F.col("_facts")[name].alias(name) for name in names])


def join_facts(df: DataFrame, facts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Left join `facts`, one row per key. `_rows` of `counts`, or else of `facts`, counts the rows of `df` with each key."""
    return salted_join(df, facts, keys, counted_hot_keys(facts if counts is None else counts, keys, hot_rows))


def join_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join a table with one row per key, after a sketch of the keys of `df`."""
    return salted_join(df, lookup, keys, hot_keys(df, keys, hot_rows))


def attach_group_facts(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, **facts: Column) -> DataFrame:
    """Add per-group aggregates to every row."""
    stats = df.groupBy(*keys).agg(
        *[value.alias(name) for name, value in facts.items()], F.count(F.lit(1)).alias(ROWS)
    )
    return join_facts(df, stats, keys, hot_rows)


def into_blocks(df: DataFrame, position: str, halo: int, block: int = 4096) -> DataFrame:
    """Assign rows to fixed-length blocks of `position`, repeating rows near an edge.

    A row within `halo` of a neighbouring block also appears there with
    `in_core` false, so a window over (key, block) sees every neighbour of its
    core rows while holding at most block + 2 * halo positions.
    """
    pos = F.col(position)

    def block_of(value: Column) -> Column:
        return F.floor(value / block)

    spans = F.sequence(block_of(pos - halo), block_of(pos + halo))
    return df.withColumn("block", F.explode(spans)).withColumn("in_core", F.col("block") == block_of(pos))
