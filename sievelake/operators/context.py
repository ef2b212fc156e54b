"""Findings joined to flow results and to their surrounding lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of
from sievelake.operators.groups import join_lookup


def transit_downgrade(findings: DataFrame, flow: DataFrame, node: str = "node") -> DataFrame:
    """Lower field findings whose data never reaches a store.

    `flow` has (source, reaches). A field that reaches a store keeps its
    severity with high confidence. Otherwise an API-tagged, untagged
    authentication or transit-path field is in transit: PAN-KEYWORD becomes
    INFO and PAN-TYPE disappears. Storage-tagged fields stay as they are.
    """
    reach = flow.select(F.col("source").alias(node), F.col("reaches").alias("_reaches"))
    joined = join_lookup(findings, reach, [node])
    ruled = F.col("rule_id").isin("PAN-KEYWORD", "PAN-TYPE") & F.col(node).isNotNull()
    stored = F.coalesce("_reaches", F.lit(False))
    untagged_transit = F.col("subject").isin(fv.SAD_FIELD_NAMES) | F.lower("path").rlike(
        any_of(fv.TRANSIT_PATH_MARKERS)
    )
    transit = ruled & ~stored & ~F.col("has_db_tag") & (F.col("has_json_tag") | untagged_transit)
    marked = joined.withColumn("_stored", ruled & stored).withColumn("_transit", transit)
    return (
        marked.filter(~(F.col("_transit") & (F.col("rule_id") == "PAN-TYPE")))
        .withColumn("severity", F.when(F.col("_transit"), F.lit("INFO")).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(F.col("_stored") | F.col("_transit"), F.lit("high")))
        .withColumn(
            "flow_note", F.when(F.col("_stored"), F.lit("stored")).when(F.col("_transit"), F.lit("transit only"))
        )
        .drop("_reaches", "_stored", "_transit")
    )


def snippets(
    findings: DataFrame,
    lines: DataFrame,
    radius: int = fv.SNIPPET_RADIUS,
) -> DataFrame:
    """(record_id, line_no, code_snippet) per distinct finding place.

    Places are widened to the few line numbers they need and joined with the lines
    by equality; Spark sends them to the lines where they turn out to be few. Each
    result gathers at most 2 * radius + 1 lines. Places without a line are left
    out. Nothing runs while the plan is built.
    """
    places = findings.select("record_id", "line_no").filter(F.col("line_no") >= 1).distinct()
    wanted = places.select(
        "record_id",
        "line_no",
        F.explode(F.sequence(F.greatest(F.col("line_no") - radius, F.lit(1)), F.col("line_no") + radius)).alias("_at"),
    )
    text = lines.select(F.col("record_id").alias("_record"), F.col("line_no").alias("_no"), F.col("line").alias("_text"))
    found = wanted.join(text, (F.col("record_id") == F.col("_record")) & (F.col("_at") == F.col("_no")))
    gap = F.col("_at") - F.col("line_no")

    def block(offsets) -> Column:
        texts = [F.max(F.when(gap == o, F.col("_text"))) for o in offsets]
        return F.array_join(F.filter(F.array(*texts), lambda t: t.isNotNull()), "\n")

    grouped = found.groupBy("record_id", "line_no").agg(
        block(range(-radius, 0)).alias("before"),
        F.max(F.when(gap == 0, F.col("_text"))).alias("line"),
        block(range(1, radius + 1)).alias("after"),
    )
    return grouped.filter(F.col("line").isNotNull()).select(
        "record_id", "line_no", F.struct("before", "line", "after").alias("code_snippet")
    )


def diff_findings(expected: DataFrame, actual: DataFrame, tolerance: int = fv.LINE_TOLERANCE) -> DataFrame:
    """Distinct (rule, severity, path, line) rows marked matched, missing or unexpected.

    Expected rows match within `tolerance` lines, or anywhere in the path for
    line 0 or no line; actual rows are unexpected when no expected row shares rule,
    severity and path. Null keys are equal to each other.

    Both sides are one table, made distinct with a mark for each side, so repeated findings do not multiply; then one sort
    by rule, severity, path and line answers everything: a frame of lines tells what is near, the whole group what is
    anywhere. A group holds at most one row for each line of a file.
    """
    keys = ["rule_id", "severity", "path"]
    both = expected.select(*keys, "line_no", F.lit(True).alias("_wanted")).unionByName(actual.select(*keys, "line_no", F.lit(False).alias("_wanted")))
    rows = both.groupBy(*keys, "line_no").agg(F.bool_or("_wanted").alias("_e"), F.bool_or(~F.col("_wanted")).alias("_a"))
    group = Window.partitionBy(*keys).orderBy("line_no")
    near, whole = group.rangeBetween(-tolerance, tolerance), Window.partitionBy(*keys)
    judged = rows.select(*keys, "line_no", "_e", "_a", F.max("_a").over(near).alias("_near"), F.max("_a").over(whole).alias("_any"), F.max("_e").over(whole).alias("_known"))
    found = F.when(F.col("line_no") > 0, F.col("_near")).otherwise(F.col("_any"))
    outcomes = F.array(F.when(F.col("_e"), F.when(found, F.lit("matched")).otherwise(F.lit("missing"))), F.when(F.col("_a") & ~F.col("_known"), F.lit("unexpected")))
    return judged.select(F.explode(outcomes).alias("outcome"), *keys, "line_no").filter("outcome IS NOT NULL")
