"""Hints, locations and reading windows for people who review findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.paths import file_location, link_window, mime_type
from sievelake.operators.context import snippets
from sievelake.operators.groups import join_lookup
from sievelake.operators.summary import drop_verified_ok


def hint_for(rule_id: Column) -> Column:
    result = None
    for prefix, text in fv.HINT_PREFIXES:
        hit = rule_id.startswith(prefix)
        result = F.when(hit, F.lit(text)) if result is None else result.when(hit, F.lit(text))
    return result.otherwise(F.lit(fv.DEFAULT_HINT))


def add_hints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("hint", hint_for(F.col("rule_id")))


def triage(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings worth reading, with location, window, MIME type, hint and snippet: one plan."""
    open_findings = add_hints(drop_verified_ok(findings))
    window = link_window("line_no")
    enriched = open_findings.withColumns(
        {
            "file_location": file_location("path"),
            "start_line": window["start_line"],
            "end_line": window["end_line"],
            "mime_type": mime_type("path"),
        }
    ).drop("code_snippet")
    return join_lookup(enriched, snippets(open_findings, lines), ["record_id", "line_no"])
