"""Retention limits in configuration groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of, base_name, last_segment, parent_key
from sievelake.operators.groups import attach_group_facts


def is_skipped_config(path: Column) -> Column:
    lower = F.lower(path)
    base = base_name(lower)
    return (
        base.isin(fv.SKIPPED_CONFIG_FILES)
        | base.rlike(any_of(fv.SKIPPED_CONFIG_WORDS))
        | lower.rlike(any_of(fv.SKIPPED_CONFIG_DIRS))
    )


def is_dev_config_path(path: Column) -> Column:
    """A '-' or '_' separated word of a folder name marks development."""
    return F.lower(path).rlike(f"(^|[/_-])({any_of(fv.DEV_CONFIG_WORDS)})([_-][^/]*)?/")


def scan_retention_groups(kv: DataFrame) -> DataFrame:
    """RET-CONFIG-NO-TTL per sensitive key group without a TTL-like sibling.

    Keys are first reduced to one row per (path, group). That row also carries
    the file-level marks, so the file test aggregates groups, not keys, and
    needs no distinct counts.
    """
    key = F.lower("key")
    rows = kv.filter(~is_skipped_config(F.col("path"))).select(
        "path",
        "line_no",
        parent_key("key").alias("parent"),
        F.lower(last_segment("key")).rlike(any_of(fv.TTL_KEYS)).alias("_ttl"),
        F.substring_index(key, ".", 1).isin(fv.SCHEMA_DOC_ROOTS).alias("_doc"),
        *[
            key.rlike(rf"(^|\.){word}(\.|$)").alias(f"_flag_{word}")
            for word in fv.FLAG_FILE_WORDS
        ],
    )
    flags = [f"_flag_{word}" for word in fv.FLAG_FILE_WORDS]
    groups = rows.groupBy("path", "parent").agg(
        F.min("line_no").alias("line_no"),
        F.bool_or("_ttl").alias("_ttl"),
        F.bool_or("_doc").alias("_doc"),
        *[F.bool_or(f).alias(f) for f in flags],
    )
    files = attach_group_facts(
        groups, ["path"], _skip_doc=F.bool_or("_doc"), **{f"{f}_any": F.bool_or(f) for f in flags}
    )
    n_flags = sum((F.col(f"{f}_any").cast("int") for f in flags[1:]), F.col(f"{flags[0]}_any").cast("int"))
    sensitive = F.lower("parent").rlike(any_of(fv.RETENTION_KEYS))
    hits = files.filter(sensitive & ~F.col("_ttl") & ~F.col("_skip_doc") & (n_flags < 2))
    dev = is_dev_config_path(F.col("path"))
    return hits.select(
        F.lit("RET-CONFIG-NO-TTL").alias("rule_id"),
        F.when(dev, F.lit("INFO")).otherwise(F.lit("HIGH")).alias("severity"),
        F.lit("3.2.1").alias("requirement_id"),
        F.lit("retention").alias("scanner"),
        F.col("path").alias("record_id"),
        "path",
        "line_no",
        F.col("parent").alias("subject"),
        F.lit("Sensitive configuration group has no retention limit").alias("description"),
        F.lit("Add a TTL or retention setting to the group").alias("suggestion"),
        F.when(dev, F.lit("high")).alias("confidence"),
        F.when(dev, F.lit("downgrade:dev_path_skipped")).alias("triage_hint"),
    )
