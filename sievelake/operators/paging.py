"""Pages of findings from a written copy in page order, with an index of positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelake import fixed_values as fv
from sievelake.functions.severity import severity_order

PART, PLACE = "page_part", "page_place"
#: Rows of a written range; a page reads the one or two ranges that it lies in.
ROWS_PER_PART = 100_000
#: Ranges of one shuffle, unless they would hold more rows than ROWS_PER_RANGE. For more than 200 partitions a task sorts all
#: that it has read in memory before it sends anything; up to 200 it writes each row as it comes.
RANGES, ROWS_PER_RANGE = 200, 4_000_000
#: Bits of monotonically_increasing_id() below the partition's number.
ID_BITS = 33
INDEX = f"{PART} long, first long, n long, total long"


@dataclass(frozen=True)
class PagedFindings:
    """Findings below `path`: `rows` in ranges of the page order, `index` with one row for each range (first position, rows, all rows)."""

    spark: SparkSession
    path: str
    schema: StructType

    def page(self, offset: int, page: int = fv.PAGE_SIZE, limit: int = 0) -> DataFrame:
        """Rows offset .. offset+page of the severity order, with row_no and next_offset (null on the last page).

        The index names the ranges, and only their files are opened. Positions were written with the rows, so
        equal rows keep their places from page to page.
        """
        if limit > page:
            raise ValueError(f"limit {limit} exceeds the page size {page}")
        size, start = limit if limit > 0 else page, max(offset, 0)
        index = self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        wanted = index.filter((F.col("first") < start + size) & (F.col("first") + F.col("n") > start)).collect()  # as many ranges as a page spans
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        spans = [(r[PART], r["first"], max(start - r["first"], 0), min(start + size - r["first"], r["n"])) for r in wanted]
        chosen, first = F.lit(False), F.lit(None).cast("long")
        for part, position, low, high in spans:
            chosen |= (F.col(PART) == part) & (F.col(PLACE) >= low) & (F.col(PLACE) < high)
            first = F.when(F.col(PART) == part, F.lit(position)).otherwise(first)
        total = wanted[0]["total"] if wanted else 0
        following = F.lit(start + size if total > start + size else None).cast("long")
        # Without a span no range is opened at all.
        found = rows.filter(chosen) if spans else rows.limit(0)
        return found.withColumn("row_no", first + F.col(PLACE) + 1).withColumn("next_offset", following).drop(PART, PLACE)


def write_pages(findings: DataFrame, path: str, order: str = "ord", ties: tuple[str, ...] = (), rows_per_part: int = ROWS_PER_PART) -> PagedFindings:
    """Write findings once, most severe first and then by `order` and `ties`, in ranges of about `rows_per_part` rows.

    One range shuffle sorts everything, and each of its ranges is cut into the written ones; a range's number and a row's place in
    it come from where the sorted rows lie. The index counts the written ranges and adds up their sizes, one row for each,
    whatever the findings hold.
    """
    spark = findings.sparkSession
    rows = findings.count()
    ranges = max(1, min(-(-rows // rows_per_part), max(RANGES, -(-rows // ROWS_PER_RANGE))))
    keys = [severity_order("severity"), F.col(order), *[F.col(t) for t in ties]]
    sorted_rows = findings.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    part = F.shiftleft(F.shiftright("_id", ID_BITS), ID_BITS) + F.floor(place / rows_per_part)
    placed = sorted_rows.withColumn(PART, part).withColumn(PLACE, place % rows_per_part).drop("_id")
    placed.write.partitionBy(PART).parquet(f"{path}/rows")
    sizes = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.withColumn("_end", F.sum("n").over(Window.orderBy(PART))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ends.select(PART, (F.col("_end") - F.col("n")).alias("first"), "n", "total").coalesce(1).write.parquet(f"{path}/index")
    return PagedFindings(spark, path, placed.schema)
