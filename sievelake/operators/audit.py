"""Audit trails and the fields of log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.policies import field_class, is_safe_log_field
from sievelake.functions.text import any_of
from sievelake.operators.groups import ROWS, join_facts
from sievelake.operators.payment import is_first_tier, tier_of
from sievelake.schemas import RowRule, apply_rules, finding, text_list, when_true
from sievelake.sources.logs import log_fields

SCANNER = "audit"


def audit_trail_coverage(ops: DataFrame, logs: DataFrame, key: str, name: str = "name") -> DataFrame:
    """One row per payment operation: structured trail, unstructured trail, or none.

    `ops` has (record_id, key, name), `logs` has (key, structured). Logs shrink
    to one row per key, operations to their facts per key, and both reach the
    operations in one join; tier 3 names count only for keys that also have a
    tier 1 operation.
    """
    trail = logs.groupBy(key).agg(
        F.bool_or("structured").alias("_structured"), F.bool_or(~F.col("structured")).alias("_unstructured")
    )
    per_key = ops.groupBy(key).agg(
        F.bool_or(is_first_tier(F.col(name))).alias("_has_first"), F.count(F.lit(1)).alias(ROWS)
    )
    facts = per_key.join(trail, key, "left")
    tiered = (
        join_facts(ops, facts, [key])
        .withColumn("tier", tier_of(F.col(name), F.col("_has_first")))
        .filter(F.col("tier") > 0)
    )
    structured = F.coalesce("_structured", F.lit(False))
    unstructured = F.coalesce("_unstructured", F.lit(False))
    by_tier = F.element_at(text_list(["CRITICAL", "HIGH", "MEDIUM"]), F.col("tier"))
    return tiered.select(
        F.when(structured, F.lit("AUDIT-LOG-OK"))
        .when(unstructured, F.lit("AUDIT-UNSTRUCTURED"))
        .otherwise(F.lit("AUDIT-NO-LOG"))
        .alias("rule_id"),
        F.when(structured, F.lit("INFO")).otherwise(by_tier).alias("severity"),
        F.lit("10.2.1").alias("requirement_id"),
        F.lit(SCANNER).alias("scanner"),
        "record_id",
        F.col(name).alias("subject"),
        F.lit("Audit trail of a payment operation").alias("description"),
        F.lit("Write a structured record for every payment operation").alias("suggestion"),
        "tier",
    )


def _normalized(field: Column) -> Column:
    return F.lower(F.translate(field, "_-.", ""))


def _matches(pattern: str):
    return lambda pair: pair["norm"].rlike(pattern)


def audit_field_coverage(records: DataFrame, fields: str = "fields", timestamp_auto: Column | None = None) -> DataFrame:
    """Which of the five audit categories a record's field names cover.

    Adds score, severity, the matched fields per category and the missing ones.
    A field may serve several categories. `timestamp_auto` marks loggers that
    stamp records themselves.
    """
    auto = F.lit(False) if timestamp_auto is None else timestamp_auto
    names = [category for category, _ in fv.AUDIT_FIELD_CATEGORIES]
    pairs = F.transform(fields, lambda f: F.struct(f.alias("name"), _normalized(f).alias("norm")))
    rows = records.withColumn("_pairs", pairs)
    for category, aliases in fv.AUDIT_FIELD_CATEGORIES:
        matched = F.array_distinct(F.filter("_pairs", _matches(any_of(aliases)))["name"])
        if category == "timestamp":
            matched = F.when(auto, F.array_union(text_list(["auto"]), matched)).otherwise(matched)
        rows = rows.withColumn(f"_{category}", matched)
    hit = {c: F.size(f"_{c}") > 0 for c in names}
    score = sum((hit[c].cast("int") for c in names[1:]), hit[names[0]].cast("int"))
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_{c}").alias("value")) for c in names]),
        lambda e: F.size(e["value"]) > 0,
    )
    missing = F.filter(
        F.array(*[F.when(~hit[c], F.lit(c)) for c in names]), lambda c: c.isNotNull()
    )
    return (
        rows.withColumn("score", score)
        .withColumn(
            "severity",
            F.when(F.col("score") >= 3, F.lit("INFO"))
            .when(F.col("score") >= 1, F.lit("MEDIUM"))
            .otherwise(F.lit("HIGH")),
        )
        .withColumn("matched", F.map_from_entries(entries))
        .withColumn("missing", missing)
        .drop("_pairs", *[f"_{c}" for c in names])
    )


def scan_audit_fields(records: DataFrame, fields: str = "fields") -> DataFrame:
    """AUDIT-FIELDS per log record that lacks audit categories, with the severity of its score."""
    auto = F.col("timestamp_auto") if "timestamp_auto" in records.columns else None
    scored = audit_field_coverage(records, fields, auto).filter(F.size("missing") > 0)
    return scored.select(
        F.lit("AUDIT-FIELDS").alias("rule_id"),
        "severity",
        F.lit("10.2.1").alias("requirement_id"),
        F.lit(SCANNER).alias("scanner"),
        "record_id",
        F.concat_ws(",", "missing").alias("subject"),
        F.lit("Log record lacks audit fields").alias("description"),
        F.lit("Record who did what, when, where from, and with what result").alias("suggestion"),
    )


def log_field_rule() -> RowRule:
    """For rows of `log_fields`; generic identifiers and safe headers are left out."""
    kind = F.col("_f_class")
    related = (
        F.when(kind == "PAN", text_list(["3.3.1", "3.5.1"]))
        .when(kind == "SECRET", text_list(["8.6.2"]))
        .otherwise(text_list([]))
    )
    made = finding(
        "HTTP-INPUT-LOG",
        F.when(kind.isin("PAN", "SECRET") | F.col("body_sourced"), F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
        "10.2.1",
        related=related,
        subject=F.col("field"),
        description="Request input is written to a log",
        suggestion="Mask or drop the field before logging",
        scanner="logs",
    )
    found = when_true([(~is_safe_log_field("field") & (kind != "GENERIC_ID"), made)])
    return RowRule(found, ({"_f_class": field_class("field")},))


def scan_log_fields(records: DataFrame, fields: str = "fields", body_sourced: str = "body_sourced") -> DataFrame:
    """HTTP-INPUT-LOG per logged field."""
    return apply_rules(log_fields(records, fields, body_sourced=body_sourced), [log_field_rule()])
