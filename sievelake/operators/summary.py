"""Counts, rankings, filters and pages of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.severity import requirement_category, severity_order, severity_rank


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per severity level, zeros included."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    levels = findings.sparkSession.createDataFrame([(s,) for s in fv.SEVERITIES], "severity string")
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rule_histogram(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent rules and how many more there are.

    The ranking window sees one row per rule, never findings.
    """
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    every_rule = Window.partitionBy()
    ranked = counts.withColumn(
        "rank", F.row_number().over(every_rule.orderBy(F.desc("n"), "rule_id"))
    ).withColumn("more_rules", F.greatest(F.count(F.lit(1)).over(every_rule) - n, F.lit(0)).cast("bigint"))
    return ranked.filter(F.col("rank") <= n)


def findings_by_rule(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Per rule: first-seen severity and requirement, and the count, most severe first.

    The instances are the findings themselves, joined by rule_id where wanted;
    they are not gathered into one row per rule.
    """
    # Count on plain keys first: a hash aggregate, where min_by over all rows would sort them.
    grid = findings.groupBy("rule_id", "severity", "requirement_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    grouped = grid.groupBy("rule_id").agg(
        F.min_by("severity", "_first").alias("severity"),
        F.min_by("requirement_id", "_first").alias("requirement_id"),
        F.sum("_n").alias("n"),
        F.min("_first").alias("first_ord"),
    )
    return grouped.orderBy(severity_order("severity"), F.desc("n"), "first_ord")


def scan_summary(findings: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Totals as (metric, name, n): all findings, by severity, by scanner, units and lines scanned."""
    grid = findings.groupBy("severity", "scanner").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        F.struct(F.lit("findings").alias("metric"), F.lit("all").alias("name")),
        F.struct(F.lit("severity").alias("metric"), F.col("severity").alias("name")),
        F.struct(F.lit("scanner").alias("metric"), F.col("scanner").alias("name")),
    )
    totals = (
        grid.select(F.explode(cells).alias("_c"), "n")
        .groupBy(F.col("_c.metric").alias("metric"), F.col("_c.name").alias("name"))
        .agg(F.sum("n").alias("n"))
    )
    if units is None:
        return totals
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    scanned = units.agg(
        F.count(F.lit(1)).cast("bigint").alias("units"),
        F.coalesce(F.sum((breaks + 1).cast("bigint")), F.lit(0)).cast("bigint").alias("lines"),
    ).unpivot([], ["units", "lines"], "name", "n")
    return totals.unionByName(scanned.select(F.lit("scanned").alias("metric"), "name", "n"))


def category_rollup(findings: DataFrame) -> DataFrame:
    """Findings per requirement category in numeric order."""
    category = requirement_category("requirement_id")
    counts = findings.groupBy(category.alias("category"), "severity").agg(F.count(F.lit(1)).alias("_n"))
    rolled = counts.groupBy("category").agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("severity").isin("CRITICAL", "HIGH"), F.col("_n"))), F.lit(0)).alias("n_severe"),
    )
    return rolled.orderBy(F.col("category").try_cast("int"), "category")


def top_n_per_severity(findings: DataFrame, n: int = 3, order: str = "ord") -> DataFrame:
    """First n findings per severity by rule and path.

    The rank filter lets Spark keep n rows per severity in every task before the
    shuffle (window group limit), so five groups do not mean five full sorts.
    """
    ranked = Window.partitionBy("severity").orderBy("rule_id", "path", order)
    return findings.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def sort_by_severity(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Most severe first, then input order: a range-partitioned sort."""
    return findings.orderBy(severity_order("severity"), order)


def paginate(
    findings: DataFrame,
    offset: int,
    page: int = fv.PAGE_SIZE,
    limit: int = 0,
    order: str = "ord",
    ties: tuple[str, ...] = (),
    bin_width: int = 1 << 20,
) -> DataFrame:
    """Rows offset .. offset+page of the severity order, with row number and next offset.

    Positions come from counts per (severity, bin of `order`), a whole number that
    nearly numbers the rows (`ties` settle repeats): a bin is bounded, so ranking
    touches only the one or two bins the page falls in, not the whole table.
    next_offset is null on the last page.
    """
    if limit > page:
        raise ValueError(f"limit {limit} exceeds the page size {page}")
    size = limit if limit > 0 else page
    start = max(offset, 0)
    binned = findings.withColumn("_sev", severity_order("severity")).withColumn(
        "_bin", F.floor(F.col(order) / bin_width)
    )
    counts = binned.groupBy("_sev", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    by_position = Window.orderBy("_sev", "_bin")
    located = (
        counts.withColumn("_end", F.sum("_n").over(by_position))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy()))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .filter((F.col("_start") < start + size) & (F.col("_end") > start))
        .drop("_n", "_end")
    )
    within = Window.partitionBy("_sev", "_bin").orderBy(order, *ties)
    rows = (
        binned.join(located, ["_sev", "_bin"])
        .withColumn("row_no", F.col("_start") + F.row_number().over(within))
        .filter((F.col("row_no") > start) & (F.col("row_no") <= start + size))
    )
    following = F.when(F.col("_total") > start + size, F.lit(start + size).cast("bigint"))
    return rows.withColumn("next_offset", following).drop("_sev", "_bin", "_start", "_total")


def filter_findings(
    findings: DataFrame, min_severity: str = "", rule_filter: str = "", limit: int = 0, order: str = "ord"
) -> DataFrame:
    """Severity threshold, rule list or /regex/, and an optional first-n limit.

    An unknown severity name sets no threshold.
    """
    out = findings
    level = min_severity.strip().upper()
    if level in fv.SEVERITIES:
        out = out.filter(F.col("severity").isin(fv.SEVERITIES[: fv.SEVERITIES.index(level) + 1]))
    wanted = rule_filter.strip()
    if len(wanted) >= 2 and wanted.startswith("/") and wanted.endswith("/"):
        out = out.filter(F.col("rule_id").rlike(wanted[1:-1]))
    elif wanted:
        out = out.filter(F.col("rule_id").isin([w.strip() for w in wanted.split(",") if w.strip()]))
    return out.orderBy(order).limit(limit) if limit > 0 else out


def drop_verified_ok(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("rule_id").endswith("-OK"))


def max_severity(severity: str) -> Column:
    """Most severe value of a group."""
    return F.max_by(severity, severity_rank(severity))
