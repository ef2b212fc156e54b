"""The compliance report: findings, suppressions, requirement status and summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.operators.context import transit_downgrade
from sievelake.operators.pairing import dedup_paired, group_repeated, repeated_members
from sievelake.operators.requirements import (
    enrich_requirements,
    gate,
    not_checked,
    propagate_related,
    report_summary,
    requirement_status,
    with_coverage,
)
from sievelake.operators.schema import dropped_column_downgrade, encryption_crossref
from sievelake.operators.summary import findings_by_rule, scan_summary, severity_counts, sort_by_severity
from sievelake.operators.suppression import apply_suppressions, exclude_packages, inline_suppressions
from sievelake.schemas import FINDING, as_findings
from sievelake.session import cut_lineage, forget


@dataclass
class Report:
    """One DataFrame per grain. `base` is cached and post-processing steps are files; call close() when done."""

    base: DataFrame
    findings: DataFrame
    suppressions: DataFrame
    status: DataFrame
    not_checked: DataFrame
    by_rule: DataFrame
    severity: DataFrame
    summary: DataFrame
    scan: DataFrame
    gate: DataFrame
    repeated: DataFrame  # PAN-TYPE findings merged per path and subject
    repeated_members: DataFrame | None  # the functions behind them, if the findings name functions

    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        self.base.unpersist()
        forget(*self.held)


def _extras(findings: DataFrame) -> list[str]:
    """Columns beyond a finding's own, which some rules add for later steps."""
    return [c for c in findings.columns if c not in FINDING.names and c != "ord"]


def post_process(findings: DataFrame, flow: DataFrame | None = None, encrypted: DataFrame | None = None, schema_events: DataFrame | None = None, hold=lambda df: df) -> DataFrame:
    """What the scanners do to their findings before they report: numbered findings in, the same columns out.

    Tag findings that repeat a field's are merged where findings have a `kind`. With `flow`, field findings that name
    a `node` and their tags are lowered or dropped where the data never reaches a store. With a list of `encrypted`
    columns, findings of the schema rules on them become INFO; with the `schema_events` of a migration history, those of columns dropped
    later do, for findings that say when (`event_ord`). Steps whose columns are missing change nothing. Each step
    reads its findings more than once, so each gets them through `hold`, which may write them down.
    """
    out, has = findings, set(findings.columns)
    if {"kind", "path", "line_no"} <= has:
        out = dedup_paired(hold(out))
    if flow is not None and {"node", "has_db_tag", "has_json_tag"} <= has:
        out = transit_downgrade(hold(out), flow)
        out = out.withColumn("triage_hint", F.coalesce("triage_hint", "flow_note")).drop("flow_note")
    of_schema = F.col("rule_id").startswith("SQL-")
    for name, group in (("table_name", 1), ("column_name", 2)):
        if name not in has:
            out = out.withColumn(name, F.when(of_schema, F.regexp_extract("subject", r"^(.*)\.([^.]*)$", group)))
    if encrypted is not None:
        out = encryption_crossref(hold(out), encrypted)
    if schema_events is not None and "event_ord" in has:
        dated = hold(out).withColumnsRenamed({"ord": "_ord", "event_ord": "ord"})
        kept = dropped_column_downgrade(dated.select("*", F.col("confidence").alias("_confidence"), F.col("triage_hint").alias("_hint")), schema_events)
        kept = kept.withColumn("confidence", F.coalesce("confidence", "_confidence")).withColumn("triage_hint", F.coalesce("triage_hint", "_hint"))
        out = kept.withColumnsRenamed({"ord": "event_ord", "_ord": "ord"})
    return out.select(*findings.columns)


def with_order(findings: DataFrame) -> DataFrame:
    """FINDING rows numbered in the order of scanner, path, line, column and rule: growing numbers with gaps.

    Rows are dealt to ranges and sorted inside each; a number's upper bits are its range, so numbers
    need no count of the ranges before. Later steps aggregate and page by plain numbers.
    """
    order = ["scanner", "path", "line_no", "col_no", "rule_id", "subject"]
    placed = as_findings(findings, keep=_extras(findings)).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("ord", F.monotonically_increasing_id())


def _rules(given):
    """Rules as a table or a list."""
    return given if isinstance(given, DataFrame) else list(given)


def compliance_report(
    findings: DataFrame,
    requirements: DataFrame,
    ignore_rules=(),
    exclude_rules=(),
    lines: DataFrame | None = None,
    units: DataFrame | None = None,
    covered=None,
    flow: DataFrame | None = None,
    encrypted: DataFrame | None = None,
    schema_events: DataFrame | None = None,
) -> Report:
    """Post-process, exclude, suppress, then derive every part of the report from one cached table.

    `flow`, `encrypted` and `schema_events` are what post_process() reads.

    Findings with a numeric `ord` keep it; others are ordered by scanner, path,
    line, column and rule. Several parts read the suppressed findings, so they
    are persisted; a lost executor only costs the recomputation of its blocks.
    `covered` of the scan's run replaces the catalogue's own, so that a rule that
    did not run leaves NOT_CHECKED and not PASS.
    """
    if covered is not None:
        requirements = with_coverage(requirements, covered)
    has_order = "ord" in findings.columns
    shaped = findings if has_order else as_findings(findings, keep=_extras(findings))
    later = {"kind", "event_ord"} & set(findings.columns)  # steps that compare by number
    if later and not has_order:
        shaped, has_order = with_order(shaped), True
    full = shaped if "triage_hint" in shaped.columns and "confidence" in shaped.columns else as_findings(shaped, keep=["ord", *_extras(shaped)])
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(cut_lineage(df))
        return held[-1]

    ordered = post_process(full, flow, encrypted, schema_events, hold)
    ordered = hold(ordered) if held else ordered
    if isinstance(exclude_rules, DataFrame) or exclude_rules:
        kept, reports = exclude_packages(ordered, _rules(exclude_rules))
        reports = reports.drop("n_dropped") if has_order else as_findings(reports)
        ordered = kept.unionByName(reports, allowMissingColumns=True)
    if not has_order:
        ordered = with_order(ordered)
    marked = apply_suppressions(ordered, _rules(ignore_rules))
    if lines is not None:
        marked = inline_suppressions(marked, lines)
    base = marked.persist()
    status = propagate_related(requirement_status(requirements, base), base)
    active = base.filter(~F.col("suppressed"))
    return Report(
        base=base,
        findings=sort_by_severity(enrich_requirements(active, requirements)),
        suppressions=base.filter("suppressed"),
        status=status,
        not_checked=not_checked(status, requirements),
        by_rule=findings_by_rule(active),
        severity=severity_counts(active),
        summary=report_summary(status, base),
        scan=scan_summary(active, units),
        gate=gate(base),
        repeated=group_repeated(active),
        repeated_members=repeated_members(active) if "function_name" in base.columns else None,
        held=held,
    )
