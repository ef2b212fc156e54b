"""Steps that several operators share."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group of this many rows is sorted by one task; larger groups are cut into bins of about this size.
ROWS_PER_BIN = 10_000


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, found by exact spelling first, so that extra columns never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def group_key(*names: str) -> Column:
    """One non-null text per combination of the columns; null differs from every value."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("-")) for c in (F.col(n).cast("string") for n in names)]
    return F.concat_ws("/", *parts)


def seeded_order(seed: str, *names: str) -> Column:
    """A hash that shuffles rows; equal rows get equal values on every attempt."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names]))


def hash_bin(order: Column, bins: int) -> Column:
    """The bin of a seeded_order() value; bins follow that order and hold about the same number of rows."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(bins))


def bins_for(rows: int, rows_per_bin: int = ROWS_PER_BIN) -> int:
    return max(1, -(-rows // rows_per_bin))


def running(df: DataFrame, groups: list[str], bin_col: str, order: list[str], value: Column, before: str, whole: str) -> DataFrame:
    """Add the sum of `value` over the rows before each row of its group, and over the whole group.

    Bins are summed first and only the sums are put in order, so a group of any
    size is spread over its bins; each task orders one bin.
    """
    keys = [*groups, bin_col]
    marked = df.withColumn("_value", value)
    sums = marked.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    rest = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_sum").over(rest.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(rest).alias(whole),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return placed.join(offsets, keys).withColumn(before, F.col("_offset") + F.col("_inside")).drop("_value", "_inside", "_offset")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
