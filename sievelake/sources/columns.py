"""Column inventories from table schemas and from DDL events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake import fixed_values as fv

COLUMNS_DDL = "table_name string, column_name string, sql_type string, ordinal int"


def inventory_of_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Name, type and position of every column, read from the schemas alone."""
    rows = [
        (table, field.name, field.dataType.simpleString(), position)
        for table, df in tables.items()
        for position, field in enumerate(df.schema.fields)
        if field.name.lower() not in fv.CONSTRAINT_WORDS
    ]
    return spark.createDataFrame(rows, COLUMNS_DDL)


def inventory_of_events(events: DataFrame) -> DataFrame:
    """Columns that exist after replaying ADD and DROP events in order.

    A column exists when its last event is an ADD. One hash aggregation with
    map-side combine: order and kind of an event travel in one number.
    """
    is_add = (F.col("op") == "ADD").cast("long")
    last = events.filter(~F.lower("column_name").isin(fv.CONSTRAINT_WORDS)).groupBy("table_name", "column_name").agg(
        F.max(F.col("ord") * 2 + is_add).alias("_last"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return last.filter(F.col("_last") % 2 == 1).drop("_last")
