"""Physical plans: what must not appear, and what must be pushed down."""

import re

import pytest

from workload.queries import QUERIES
from workload.views import view

STREAMED = {"st01_scan_stream"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMED])
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("r08_scan_plain_http", {"page_id", "url"}),
        ("r01_scan_pan_literals", {"doc_id", "text"}),
        ("a01_severity_counts", {"l_linenumber"}),
        ("src06_flatten_json", {"event_id", "props"}),
    ],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf_dir)))
    assert {c.split(":")[0] for c in schemas[0].split(",")} == columns


def test_ranks_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["w01_top_n_per_severity"](spark, sf_dir))
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]


@pytest.mark.parametrize("name", ["r05_scan_secrets_documents", "r10_scan_scripts", "r19_scan_log_fields", "r18_audit_field_coverage", "j04_apply_suppressions", "src04_to_lines"])
def test_row_local_work_does_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["a01_severity_counts", "a02_rule_histogram", "a11_category_rollup", "r22_license_counts"])
def test_aggregates_combine_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_", plan)


@pytest.mark.parametrize("name", ["a03_findings_by_rule", "a05_requirement_status", "a06_propagate_related"])
def test_the_large_input_meets_a_hash_aggregate(spark, sf_dir, name):
    """Sort aggregates may only appear above a first, hash-based reduction."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    lowest = [line for line in plan.split("\n") if "Aggregate(" in line][-1]
    assert " HashAggregate(" in lowest or "- HashAggregate(" in lowest


@pytest.mark.parametrize(
    "name",
    ["r03_scan_pan_columns", "r15_scan_schema_columns", "r16_scan_retention_groups", "r17_audit_trail_coverage", "r21_payment_tier", "j05_inline_suppressions", "j07_encryption_crossref", "j09_transit_downgrade", "w04_dropped_column_downgrade", "w05_dedup_paired"],
)
def test_group_facts_are_joined_without_hints(spark, sf_dir, name):
    """Spark's own size check decides what is broadcast; no hint does."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution()
    assert "ResolvedHint" not in plan.analyzed().toString()
    assert "approx_top_k" in plan.analyzed().toString() or "_rows" in plan.analyzed().toString()


def test_the_scan_reads_settings_from_one_copy(spark, sf_dir):
    """The settings view joins the part table with itself: once, by a merge join, not in every rule that reads it."""
    assert "postgres://u" not in plan_of(QUERIES["s01_run_scans"](spark, sf_dir))
    merged, free = view(spark, sf_dir, "v_kv", hint="MERGE(p, v)"), view(spark, sf_dir, "v_kv")
    assert "SortMergeJoin" in plan_of(merged) and "BroadcastExchange" not in plan_of(merged)
    assert merged.exceptAll(free).isEmpty() and free.exceptAll(merged).isEmpty()
