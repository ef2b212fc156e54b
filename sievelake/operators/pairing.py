"""Merging findings that describe the same field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.severity import severity_of_rank, severity_rank
from sievelake.functions.text import normalize_name
from sievelake.operators.groups import ROWS, join_facts


def dedup_paired(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Drop the tag finding that repeats a field finding at the same place.

    Per (path, line_no) the last field and the last tag PAN-KEYWORD finding are
    compared; with equal normalised subjects the field finding stays with the
    higher severity. Only their numbers are aggregated over all findings, so a
    crowded place is not gathered.
    """
    place = ["path", "line_no"]
    pan = F.col("rule_id") == "PAN-KEYWORD"

    def last(kind: str) -> Column:
        return F.max(F.when(pan & (F.col("kind") == kind), F.col(order)))

    # Numbers first, in a hash aggregate; then the two rows of each place that they name.
    places = findings.groupBy(*place).agg(last("field").alias("_field"), last("tag").alias("_tag"), F.count(F.lit(1)).alias(ROWS))
    ends = places.filter("_field IS NOT NULL AND _tag IS NOT NULL")
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in place], F.explode(F.array("_field", "_tag")).alias("_end"))
    rows = findings.filter(pan).select(*place, F.col(order).alias("_ord"), "kind", normalize_name(F.col("subject")).alias("_name"), severity_rank("severity").alias("_rank"))
    named = (F.col("_ord") == F.col("_end")) & F.col("path").eqNullSafe(F.col("_path")) & F.col("line_no").eqNullSafe(F.col("_line_no"))
    picked = rows.join(ends, named)

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    pairs = picked.groupBy(*place).agg(
        of("field", "_ord").alias("_field_ord"), of("tag", "_ord").alias("_tag_ord"), F.max("_rank").alias("_rank"), of("field", "_name").alias("_field_name"), of("tag", "_name").alias("_tag_name")
    )
    facts = pairs.filter("_field_name = _tag_name").select(*place, "_field_ord", "_tag_ord", "_rank")
    joined = join_facts(findings, facts, place, counts=places)
    kept = joined.filter(F.col("_tag_ord").isNull() | (F.col(order) != F.col("_tag_ord")))
    raised = F.col("_field_ord") == F.col(order)
    return kept.withColumn(
        "severity", F.when(raised, severity_of_rank(F.col("_rank"))).otherwise(F.col("severity"))
    ).drop("_field_ord", "_tag_ord", "_rank")


def group_repeated(findings: DataFrame, order: str = "ord") -> DataFrame:
    """PAN-TYPE findings merged per (path, subject): count, severity and first occurrence.

    Function names stay in `repeated_members`, one row each, instead of a list
    that could grow without bound.
    """
    typed = findings.filter(F.col("rule_id") == "PAN-TYPE")
    merged = typed.groupBy("path", "subject").agg(
        F.max(severity_rank("severity")).alias("_rank"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord")
    )
    return merged.select(
        "path",
        "subject",
        F.lit("PAN-TYPE").alias("rule_id"),
        severity_of_rank(F.col("_rank")).alias("severity"),
        "n",
        "first_ord",
    )


def repeated_members(findings: DataFrame) -> DataFrame:
    """Distinct functions behind each merged row, as (path, subject, function_name)."""
    typed = findings.filter(F.col("rule_id") == "PAN-TYPE")
    return typed.select("path", "subject", "function_name").distinct()
