"""Card numbers in text, configuration, schemas and log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.cards import (
    card_brand,
    classify_pan_sad,
    extract_digits,
    is_likely_pan,
    is_sensitive_keyword,
    requirement_for,
)
from sievelake.functions.text import contains_any, normalize_name
from sievelake.operators.groups import attach_group_facts
from sievelake.schemas import RowRule, apply_rules, finding, when_true
from sievelake.sources.logs import log_fields
from sievelake.sources.units import to_lines

SCANNER = "cards"
# A whole alphanumeric token of 13 to 19 digits.
CARD_TOKEN = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
ASSIGNED_NAME = r"([A-Za-z_][A-Za-z0-9_-]*)[ \t]*(?::=|=|:)"


def scan_pan_literals(units: DataFrame, keep=()) -> DataFrame:
    """PAN-LITERAL per card-number token; CRITICAL on a line that assigns a sensitive name.

    Whole texts are tested once by a cheap digit pattern; only texts with a long
    digit run are split into lines, so the line explode stays small.
    """
    lines = to_lines(units.filter(F.col("text").rlike(r"[0-9]{13}")), keep).filter(F.col("line").rlike(CARD_TOKEN))
    names = F.regexp_extract_all("line", F.lit(ASSIGNED_NAME), 1)
    tokens = lines.select(
        "record_id",
        "path",
        "line_no",
        "line",
        *keep,
        F.exists(names, is_sensitive_keyword).alias("_bound"),
        F.explode(F.regexp_extract_all("line", F.lit(CARD_TOKEN), 0)).alias("_token"),
    ).filter(is_likely_pan("_token"))
    return tokens.select(
        F.lit("PAN-LITERAL").alias("rule_id"),
        F.when(F.col("_bound"), F.lit("CRITICAL")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.lit("3.4.1").alias("requirement_id"),
        F.lit(SCANNER).alias("scanner"),
        "record_id",
        "path",
        "line_no",
        F.instr("line", F.col("_token")).alias("col_no"),
        F.concat(card_brand("_token"), F.lit(" *"), F.right("_token", F.lit(4))).alias("subject"),
        F.lit("Token has the shape and check digit of a card number").alias("description"),
        F.lit("Replace the number by a token reference").alias("suggestion"),
        *keep,
    )


def kv_pan_rule() -> RowRule:
    literal = finding(
        "PAN-LITERAL",
        "CRITICAL",
        "3.4.1",
        subject=F.col("key"),
        description="Configuration value is a card number",
        suggestion="Keep card numbers out of configuration; use a token reference",
        scanner=SCANNER,
    )
    keyword = finding(
        "PAN-KEYWORD",
        "HIGH",
        "3.3.1",
        related=["3.3.1.2"],
        subject=F.col("key"),
        description="Configuration key names cardholder data",
        suggestion="Inject the value from a vault at run time",
        scanner=SCANNER,
    )
    return RowRule(
        when_true(
            [
                (is_likely_pan(F.col("_c_digits")), literal),
                (is_sensitive_keyword("key") & (F.col("value") != ""), keyword),
            ]
        ),
        ({"_c_digits": extract_digits("value")},),
    )


def scan_kv_pan(kv: DataFrame) -> DataFrame:
    """PAN-LITERAL on values, PAN-KEYWORD on keys; one row may give both."""
    return apply_rules(kv, [kv_pan_rule()])


def scan_pan_columns(columns: DataFrame) -> DataFrame:
    """PAN-KEYWORD per sensitive column, with severity from the table it belongs to."""
    norm = normalize_name("column_name")
    facts = attach_group_facts(
        columns.withColumn("_norm", norm),
        ["table_name"],
        _payment=F.count_if(F.col("_norm").isin(fv.PAYMENT_INDICATORS)),
        _banking=F.count_if(F.col("_norm").isin(fv.BANKING_SIBLINGS)),
        _card=F.bool_or(F.col("_norm").isin(fv.CARD_SCOPE_SIBLINGS)),
    ).filter(is_sensitive_keyword("column_name"))
    bank_account = (
        (F.col("_norm") == "accountnumber")
        & (F.col("_banking") >= 2)
        & ~F.col("_card")
        & ~contains_any(F.lower("table_name"), fv.TOKENISATION_WORDS)
    )
    requirement = requirement_for(classify_pan_sad("column_name"), "field")
    return facts.select(
        F.lit("PAN-KEYWORD").alias("rule_id"),
        F.when(bank_account, F.lit("INFO"))
        .when(F.col("_payment") >= 2, F.lit("CRITICAL"))
        .otherwise(F.lit("HIGH"))
        .alias("severity"),
        requirement["requirement_id"].alias("requirement_id"),
        F.lit(SCANNER).alias("scanner"),
        F.col("table_name").alias("record_id"),
        F.col("table_name").alias("path"),
        F.col("ordinal").alias("line_no"),
        F.concat_ws(".", "table_name", "column_name").alias("subject"),
        F.lit("Column name indicates cardholder data").alias("description"),
        F.lit("Store a token or an encrypted reference").alias("suggestion"),
        requirement["related"].alias("related_requirements"),
        F.when(F.col("_payment") >= 2, F.lit("high")).otherwise(F.lit("low")).alias("confidence"),
        F.when(bank_account, F.lit("banking_domain")).alias("triage_hint"),
    )


def log_pan_rule() -> RowRule:
    """For rows of `log_fields`: one logged field each, with its text when known."""
    named = is_sensitive_keyword("field")
    numbered = F.coalesce(is_likely_pan(extract_digits("field_value")), F.lit(False))
    requirement = requirement_for(F.when(named, classify_pan_sad("field")).otherwise(F.lit("PAN")), "logger")
    made = finding(
        "PAN-LOGGER",
        "CRITICAL",
        F.col("_l_requirement.requirement_id"),
        related=F.col("_l_requirement.related"),
        subject=F.col("field"),
        description="Log record carries cardholder data",
        suggestion="Mask the field or log a token reference",
        scanner=SCANNER,
    )
    hit = F.col("_l_requirement").isNotNull()
    return RowRule(when_true([(hit, made)]), ({"_l_requirement": F.when(named | numbered, requirement)},))


def scan_log_pan(logs: DataFrame, fields: str = "fields", values: str | None = None) -> DataFrame:
    """PAN-LOGGER per logged field that names card data or holds a card number.

    `fields` is an array of names; `values`, if given, an array of their texts.
    """
    return apply_rules(log_fields(logs, fields, values), [log_pan_rule()])
