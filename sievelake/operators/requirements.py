"""Findings against the requirement catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.severity import is_actionable

MAX_BROADCAST_REQUIREMENTS = 100_000


def catalogue(dim: DataFrame) -> DataFrame:
    """Requirement rows as a broadcast side. The catalogue is a published standard, so its
    size does not follow the data; it is checked all the same before the hint is given."""
    return F.broadcast(dim) if dim.limit(MAX_BROADCAST_REQUIREMENTS + 1).count() <= MAX_BROADCAST_REQUIREMENTS else dim


def enrich_requirements(findings: DataFrame, dim: DataFrame) -> DataFrame:
    titles = dim.select("requirement_id", F.col("title").alias("requirement_title"))
    joined = findings.join(catalogue(titles), "requirement_id", "left")
    return joined.withColumn("requirement_title", F.coalesce("requirement_title", F.lit("")))


def explain_requirements(ids: DataFrame, dim: DataFrame, column: str = "requirement_id") -> DataFrame:
    """Catalogue row per asked id; ids are trimmed and unknown ones get an error text."""
    asked = ids.select(F.trim(F.col(column)).alias("requirement_id")).distinct()
    joined = asked.join(catalogue(dim), "requirement_id", "left")
    unknown = F.concat(F.lit("unknown requirement "), F.col("requirement_id"))
    return joined.withColumn("error", F.when(F.col("title").isNull(), unknown))


def is_active(findings: DataFrame) -> Column:
    return ~F.col("suppressed") if "suppressed" in findings.columns else F.lit(True)


def with_coverage(dim: DataFrame, covered) -> DataFrame:
    """The catalogue with `covered` as a scan's rules give it: what no rule that ran checks is not checked."""
    return dim.withColumn("covered", F.col("requirement_id").isin(sorted(covered)))


def requirement_status(dim: DataFrame, findings: DataFrame) -> DataFrame:
    """NOT_CHECKED, FAIL, SUPPRESSED or PASS per requirement.

    Findings shrink to one row per requirement before they meet the catalogue.
    """
    active = is_active(findings)
    counts = findings.groupBy("requirement_id").agg(
        F.count_if(active).alias("_active"),
        F.count_if(~active).alias("_suppressed"),
        F.bool_or(active & is_actionable("severity")).alias("_actionable"),
    )
    joined = dim.join(counts, "requirement_id", "left")
    covered = F.coalesce(F.col("covered"), F.lit(False))
    fails = F.coalesce(F.col("_actionable"), F.lit(False))
    only_suppressed = (F.coalesce("_active", F.lit(0)) == 0) & (F.coalesce("_suppressed", F.lit(0)) > 0)
    return joined.select(
        "requirement_id",
        "title",
        F.when(~covered, F.lit("NOT_CHECKED"))
        .when(fails, F.lit("FAIL"))
        .when(only_suppressed, F.lit("SUPPRESSED"))
        .otherwise(F.lit("PASS"))
        .alias("status"),
        F.when(covered & fails, F.col("_active"))
        .when(covered & only_suppressed, F.col("_suppressed"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("finding_count"),
    )


def propagate_related(status: DataFrame, findings: DataFrame, order: str = "ord") -> DataFrame:
    """Give NOT_CHECKED requirements the status of the first active finding that relates to them.

    "First" is the smallest `order`. Pairs of requirements are reduced first, so
    the choice runs on a handful of rows.
    """
    primary = (
        findings.filter(is_active(findings))
        .select(F.explode("related_requirements").alias("_related"), "requirement_id", F.col(order).alias("_order"))
        .groupBy("_related", "requirement_id")
        .agg(F.min("_order").alias("_first"))
        .groupBy("_related")
        .agg(F.min_by("requirement_id", "_first").alias("_primary"))
    )
    source = status.select(F.col("requirement_id").alias("_primary"), F.col("status").alias("_status"))
    joined = (
        status.join(primary, status["requirement_id"] == primary["_related"], "left").join(source, "_primary", "left")
    )
    taken = (F.col("status") == "NOT_CHECKED") & F.col("_status").isNotNull()
    return joined.select(
        "requirement_id",
        "title",
        F.when(taken, F.col("_status")).otherwise(F.col("status")).alias("status"),
        "finding_count",
        F.when(taken, F.concat(F.lit("same finding as "), F.col("_primary"))).otherwise(F.lit("")).alias("cross_reference"),
    )


def not_checked(status: DataFrame, dim: DataFrame) -> DataFrame:
    """Why each unchecked requirement was not checked: parent, stated reason, manual review."""
    parents = dim.select(F.col("requirement_id").alias("covered_by"), F.col("title").alias("_parent_title"))
    facts = dim.select("requirement_id", "covered_by", "reason").join(parents, "covered_by", "left")
    open_rows = status.filter(F.col("status") == "NOT_CHECKED").select("requirement_id", "title")
    by_parent = F.concat(
        F.lit("partly covered by "),
        F.col("covered_by"),
        F.lit(" "),
        F.coalesce("_parent_title", "covered_by"),
    )
    return open_rows.join(facts, "requirement_id", "left").select(
        "requirement_id",
        "title",
        F.when(F.coalesce("covered_by", F.lit("")) != "", by_parent)
        .when(F.coalesce("reason", F.lit("")) != "", F.col("reason"))
        .otherwise(F.concat(F.col("title"), F.lit(" needs manual review")))
        .alias("explanation"),
    )


def report_summary(status: DataFrame, findings: DataFrame) -> DataFrame:
    """Status and severity counts as (metric, n) rows, with the gate as a 0/1 metric.

    Both inputs are reduced by their own aggregate; the two one-row results meet
    as rows of a union, so neither is joined to the other.
    """
    names = {"PASS": "pass", "FAIL": "fail", "SUPPRESSED": "suppressed", "NOT_CHECKED": "not_checked"}
    statuses = status.agg(
        F.count(F.lit(1)).alias("total_requirements"),
        F.count_if(F.col("status") != "NOT_CHECKED").alias("checked"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()],
    )
    active = findings.filter(is_active(findings))
    severities = active.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fv.SEVERITIES],
        F.coalesce(F.max(is_actionable("severity").cast("bigint")), F.lit(0)).cast("bigint").alias("gate_failed"),
    )
    return _as_metrics(statuses).unionByName(_as_metrics(severities))


def _as_metrics(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "metric", "n")


def gate(findings: DataFrame) -> DataFrame:
    """One row: FAIL when an active finding is at least MEDIUM, else PASS."""
    failed = F.coalesce(F.max(is_active(findings) & is_actionable("severity")), F.lit(False))
    return findings.agg(F.when(failed, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("overall"))


def rule_map(spark: SparkSession) -> DataFrame:
    """(rule_id, requirement_id) pairs that a scan's findings may have: the canonical ones and those of the rules here."""
    return spark.createDataFrame(fv.RULE_REQUIREMENTS + fv.OWN_RULE_REQUIREMENTS, "rule_id string, requirement_id string")


def mapping_drift(findings: DataFrame, rule_map: DataFrame) -> DataFrame:
    """(rule, requirement) pairs that findings use but the canonical table lacks."""
    used = findings.groupBy("rule_id", "requirement_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return used.join(rule_map, ["rule_id", "requirement_id"], "left_anti")
