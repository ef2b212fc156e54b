"""Secrets, hard-coded keys and passwords in key/value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.paths import dev_context, has_test_helper_segment
from sievelake.functions.secrets import (
    has_placeholder_substring,
    is_basic_placeholder,
    is_character_set,
    is_connection_string,
    is_credential_key,
    is_excluded_literal,
    is_high_entropy,
    is_non_secret,
    is_password_placeholder,
    is_path_or_url_pair,
    is_sql_text,
    secret_prefix,
    shannon_entropy,
)
from sievelake.functions.text import contains_any, last_segment
from sievelake.functions.words import keyword_at_boundary
from sievelake.schemas import RowRule, apply_rules, finding, when_true

ADVICE = "Inject the value from a secrets manager at run time"


def secret_rule() -> RowRule:
    """Token prefixes, connection strings, credential keys and random values.

    Placeholders and SQL texts give nothing. Placeholder fragments and path or
    URL values stop the key-name rules but not the first two, and a placeholder
    fragment also keeps those two at their own severity.
    """
    live, fragment, pair = F.col("_s_live"), F.col("_s_fragment"), F.col("_s_pair")
    prefix, connection, credential = F.col("_s_prefix"), F.col("_s_connection"), F.col("_s_credential")
    critical, high = F.col("_s_critical"), F.col("_s_high")
    hit = prefix.isNotNull() | connection | credential
    stages = (
        {
            "_s_live": ~is_basic_placeholder("value") & ~is_sql_text("value"),
            "_s_fragment": has_placeholder_substring("value"),
            "_s_pair": is_path_or_url_pair("key", "value"),
        },
        {
            "_s_prefix": F.when(live, secret_prefix("value")),
            "_s_connection": live & is_connection_string("value"),
            "_s_credential": live & ~fragment & ~pair & is_credential_key("key"),
        },
        {
            "_s_critical": F.when(hit, dev_context("path", "value", F.lit("CRITICAL"))),
            "_s_high": F.when(credential, dev_context("path", "value", F.lit("HIGH"))),
        },
    )

    def outcome(rule_id: str, base: str, context: Column, description) -> Column:
        return finding(
            rule_id,
            F.when(fragment, F.lit(base)).otherwise(context["severity"]),
            "8.6.2",
            subject=F.col("key"),
            description=description,
            suggestion=ADVICE,
            dev_context=~fragment & context["dev_context"],
            triage_hint=F.when(~fragment & ~pair & context["examples"], F.lit("dev_path_examples_skipped")),
            scanner="secrets",
        )

    found = when_true(
        [
            (
                prefix.isNotNull(),
                outcome("SEC-PREFIX", "CRITICAL", critical, F.concat(prefix, F.lit(" in configuration"))),
            ),
            (connection, outcome("SEC-CONNSTR", "CRITICAL", critical, "Connection string holds a password")),
            (credential, outcome("SEC-CREDENTIAL-KEY", "CRITICAL", critical, "Credential key has a literal value")),
            (
                credential & is_high_entropy("value"),
                outcome("SEC-HIGH-ENTROPY", "HIGH", high, "Credential key has a random-looking value"),
            ),
        ]
    )
    return RowRule(found, stages)


def scan_secrets(kv: DataFrame) -> DataFrame:
    return apply_rules(kv, [secret_rule()])


def hardcoded_key_rule() -> RowRule:
    """CRYPTO-HARDCODED-KEY: by name, by entropy, by encoding; the first tier wins.

    The tier sets a severity that the environment may lower. The value's shape
    then decides: error texts and identifier shapes are INFO, encoded keys
    CRITICAL, and files of constants at most HIGH.
    """
    value, live, tier = F.col("value"), F.col("_k_live"), F.col("_k_tier")
    name, entropy, size = F.col("_k_name"), F.col("_k_entropy"), F.octet_length(F.col("value"))
    context, shape, encoded = F.col("_k_context"), F.col("_k_shape"), F.col("_k_encoded")
    plain = (entropy < 4.5) & (size <= 40)
    error_text = name.rlike(fv.ERROR_VARIABLE_PATTERN) & contains_any(F.lower(value), fv.ERROR_TEXT_WORDS)
    stages = (
        {
            "_k_live": ~is_excluded_literal("value")
            & ~is_sql_text("value")
            & ~is_non_secret("value")
            & ~is_character_set("value"),
            "_k_name": last_segment("key"),
        },
        {"_k_entropy": F.when(live, shannon_entropy("value"))},
        {
            "_k_tier": F.when(
                live,
                F.when(keyword_at_boundary(name, fv.KEY_WORDS) & (entropy >= 3.0), F.lit(1))
                .when((size >= fv.ENTROPY_MIN_BYTES) & (entropy > fv.ENTROPY_THRESHOLD), F.lit(2))
                .when(value.rlike(fv.BASE64_PATTERN) | value.rlike(fv.HEX_PATTERN), F.lit(3)),
            )
        },
        {
            "_k_context": F.when(
                tier.isNotNull(),
                dev_context("path", "value", F.when(tier == 1, F.lit("CRITICAL")).otherwise(F.lit("HIGH"))),
            ),
            "_k_shape": F.when(
                tier.isNotNull(),
                F.when(error_text, F.lit("hardcoded_sentinel_error"))
                .when(plain & value.rlike(fv.HEADER_NAME_PATTERN), F.lit("hardcoded_header_name"))
                .when(plain & value.rlike(fv.SNAKE_CASE_PATTERN), F.lit("hardcoded_log_field"))
                .when(plain & (size <= 20) & value.rlike(fv.JSON_KEY_PATTERN), F.lit("hardcoded_json_key")),
            ),
            "_k_encoded": tier.isNotNull()
            & (
                ((size >= 32) & value.rlike(fv.PURE_HEX_PATTERN))
                | ((size >= 24) & value.rlike(fv.BASE64_CHARSET_PATTERN) & (entropy >= 4.0))
            ),
        },
    )
    constants = F.col("path").rlike(fv.CONSTANTS_FILE_PATTERN)
    severity = (
        F.when(shape.isNotNull(), F.lit("INFO"))
        .when(encoded, F.lit("CRITICAL"))
        .when(constants & (context["severity"] == "CRITICAL"), F.lit("HIGH"))
        .otherwise(context["severity"])
    )
    made = finding(
        "CRYPTO-HARDCODED-KEY",
        severity,
        "6.2.4",
        related=["8.6.2"],
        subject=F.col("key"),
        description=F.concat(F.lit("Literal key material, tier "), tier.cast("string")),
        suggestion=ADVICE,
        dev_context=context["dev_context"],
        triage_hint=F.coalesce(shape, F.when(~encoded & constants, F.lit("crypto_key_constants_file"))),
        scanner="crypto",
    )
    return RowRule(when_true([(tier.isNotNull(), made)]), stages)


def scan_hardcoded_keys(kv: DataFrame) -> DataFrame:
    return apply_rules(kv, [hardcoded_key_rule()])


def password_rule() -> RowRule:
    """AUTH-HARDCODED-PWD: password-like names; placeholders are INFO unless in production."""
    named, placeholder, context = F.col("_p_named"), F.col("_p_placeholder"), F.col("_p_context")
    helper = F.col("_p_helper")
    base = F.when(placeholder, F.lit("INFO")).otherwise(F.lit("CRITICAL"))
    stages = (
        {
            "_p_named": keyword_at_boundary(last_segment("key"), fv.PASSWORD_WORDS),
            "_p_placeholder": is_password_placeholder("value"),
        },
        {
            "_p_context": F.when(named, dev_context("path", "value", base)),
            "_p_helper": named & has_test_helper_segment(F.col("path")),
        },
    )
    made = finding(
        "AUTH-HARDCODED-PWD",
        F.when(helper, F.lit("INFO")).otherwise(context["severity"]),
        "8.6.2",
        related=["8.3.1"],
        subject=F.col("key"),
        description=F.when(placeholder, F.lit("Password is a placeholder")).otherwise(F.lit("Password is a literal")),
        suggestion=ADVICE,
        confidence=F.when(helper, F.lit("high")),
        dev_context=context["dev_context"],
        triage_hint=F.when(helper, F.lit("downgrade:testutil_exclusion")),
        scanner="auth",
    )
    return RowRule(when_true([(named, made)]), stages)


def scan_hardcoded_passwords(kv: DataFrame) -> DataFrame:
    return apply_rules(kv, [password_rule()])
