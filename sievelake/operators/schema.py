"""Sensitive columns in schemas, encryption records and schema history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.cards import classify_pan_sad, is_sensitive_keyword
from sievelake.functions.policies import is_plaintext_type
from sievelake.functions.text import contains_any, normalize_name
from sievelake.operators.groups import ROWS, attach_group_facts, join_facts, join_lookup
from sievelake.schemas import emit, finding


def is_pan_like(column: Column) -> Column:
    return is_sensitive_keyword(column) | normalize_name(column).isin(fv.ACCOUNT_LIKE_COLUMNS)


def is_expiry_column(column: Column) -> Column:
    return F.lower(column).isin(fv.EXPIRY_COLUMNS)


def scan_schema_columns(columns: DataFrame) -> DataFrame:
    """SQL-SENSITIVE-COLUMN, and SQL-TEXT-TYPE when such a column stores plain text.

    A table protects its PAN when its first PAN-like column is binary or absent.
    Context names count in card tables only, expiry names only there and only
    while the PAN is unprotected.
    """
    # Position and protection of a PAN-like column in one number: the smallest one tells
    # whether the first such column is binary, and numbers aggregate by hash.
    readable = (F.lower("sql_type") != "bytea").cast("long")
    rows = attach_group_facts(
        columns,
        ["table_name"],
        _first_pan=F.min(F.when(is_pan_like(F.col("column_name")), F.col("ordinal").cast("long") * 2 + readable)),
    )
    protected = F.coalesce(F.col("_first_pan") % 2 == 0, F.lit(True))
    norm = normalize_name("column_name")
    card_table = contains_any(normalize_name("table_name"), fv.CARD_TABLE_WORDS)
    sensitive = is_sensitive_keyword("column_name") | (
        card_table
        & (norm.isin(fv.CARD_CONTEXT_COLUMNS) | (~protected & norm.isin(fv.EXPIRY_CONTEXT_COLUMNS)))
    )
    hits = (
        rows.filter(sensitive & ~(is_expiry_column(F.col("column_name")) & protected))
        .withColumn("record_id", F.col("table_name"))
        .withColumn("path", F.col("table_name"))
        .withColumn("line_no", F.col("ordinal"))
    )
    subject = F.concat_ws(".", "table_name", "column_name")
    requirement = F.when(classify_pan_sad("column_name") == "PAN", F.lit("3.5.1")).otherwise(F.lit("3.3.1"))
    return emit(
        hits,
        "schema",
        [
            (
                F.lit(True),
                finding(
                    "SQL-SENSITIVE-COLUMN",
                    "HIGH",
                    requirement,
                    subject=subject,
                    description="Column stores cardholder data",
                    suggestion="Drop authentication data; encrypt card numbers before storing them",
                    confidence="high",
                ),
            ),
            (
                is_plaintext_type("sql_type"),
                finding(
                    "SQL-TEXT-TYPE",
                    "MEDIUM",
                    "3.5.1",
                    subject=subject,
                    description="Sensitive column has a plain-text type",
                    suggestion="Use a binary type holding encrypted bytes",
                    confidence="high",
                ),
            ),
        ],
        keep=("table_name", "column_name"),
    )


def encryption_crossref(findings: DataFrame, encrypted: DataFrame) -> DataFrame:
    """Use a list of application-encrypted columns (table_name, column_name).

    An encrypted column's findings become INFO. Expiry findings vanish in tables
    whose PAN is encrypted; the plain-text type finding stays.
    """
    marks = encrypted.select(
        F.lower("table_name").alias("_table"), F.lower("column_name").alias("_column")
    ).distinct()
    tables = marks.groupBy("_table").agg(F.bool_or(is_pan_like(F.col("_column"))).alias("_pan_encrypted"))
    joined = (
        findings.withColumn("_table", F.lower("table_name"))
        .withColumn("_column", F.lower("column_name"))
    )
    # Both marks are looked up for distinct columns, and reach the findings in one join.
    columns = ["_table", "_column"]
    facts = (
        joined.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias(ROWS))
        .join(marks.withColumn("_encrypted", F.lit(True)), columns, "left")
        .join(tables, "_table", "left")
    )
    joined = join_facts(joined, facts, columns)
    encrypted_flag = F.coalesce(F.col("_encrypted"), F.lit(False))
    dropped = (
        (F.col("rule_id") == "SQL-SENSITIVE-COLUMN")
        & is_expiry_column(F.col("column_name"))
        & F.coalesce(F.col("_pan_encrypted"), F.lit(False))
    )
    return (
        joined.filter(~dropped)
        .withColumn("severity", F.when(encrypted_flag, F.lit("INFO")).otherwise(F.col("severity")))
        .withColumn(
            "triage_hint",
            F.when(encrypted_flag, F.lit("encrypted by the application")).otherwise(F.col("triage_hint")),
        )
        .drop("_table", "_column", "_encrypted", "_pan_encrypted")
    )


def dropped_column_downgrade(findings: DataFrame, events: DataFrame) -> DataFrame:
    """INFO for columns that a later event drops and none re-adds after that first drop.

    Findings carry (table_name, column_name, ord); events (table_name, ord, op,
    column_name). With L the last ADD, the first drop after a finding is final
    exactly when no drop lies between the finding and L and some drop follows
    both. That needs only three per-column aggregates, so a column with a very
    long history is never sorted or gathered in one task.
    """
    keys = ["table_name", "column_name"]
    is_add, is_drop = F.col("op") == "ADD", F.col("op") == "DROP"
    last = events.groupBy(*keys).agg(
        F.max(F.when(is_add, F.col("ord"))).alias("_last_add"),
        F.max(F.when(is_drop, F.col("ord"))).alias("_last_drop"),
    )
    earlier = (
        events.filter(is_drop)
        .transform(lambda drops: join_lookup(drops, last.select(*keys, "_last_add"), keys))
        .filter(F.col("ord") < F.col("_last_add"))
        .groupBy(*keys)
        .agg(F.max("ord").alias("_drop_before_add"))
    )
    joined = join_lookup(findings, last.join(earlier, keys, "left"), keys)
    # greatest() skips nulls, so a column without ADD events compares by its own ord.
    final_drop = (F.col("_last_drop") > F.greatest("ord", "_last_add")) & (
        F.col("_drop_before_add").isNull() | (F.col("_drop_before_add") <= F.col("ord"))
    )
    dropped = F.coalesce(final_drop, F.lit(False)) & (F.col("severity") != "INFO")
    return (
        joined.withColumn("_dropped", dropped)
        .withColumn("severity", F.when(F.col("_dropped"), F.lit("INFO")).otherwise(F.col("severity")))
        .withColumn("confidence", F.when(F.col("_dropped"), F.lit("high")).cast("string"))
        .withColumn("triage_hint", F.when(F.col("_dropped"), F.lit("downgrade:column_dropped_later")).cast("string"))
        .drop("_last_add", "_last_drop", "_drop_before_add", "_dropped")
    )
