"""Browser content policies, TLS settings, column types and log field names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of, col, contains_any, normalize_name, strip

CSP_FLAGS = [
    "has_script_src",
    "has_default_src",
    "no_script_restriction",
    "has_unsafe_inline",
    "has_unsafe_eval",
    "has_nonce",
    "has_strict_dynamic",
    "analyzable",
]


def parse_csp(policy: Column | str) -> Column:
    """Flags of the directive that governs scripts; null for a null policy.

    script-src wins over default-src, and the last of equal directives counts.
    A nonce or strict-dynamic cancels unsafe-inline but not unsafe-eval.
    """
    policy = col(policy)
    directives = F.transform(F.split(F.lower(policy), ";"), lambda d: F.split(strip(d), r"[ \t\r\n\f]+"))

    def last(name: str) -> Column:
        return F.try_element_at(F.filter(directives, lambda d: F.get(d, F.lit(0)) == name), F.lit(-1))

    script, default = last("script-src"), last("default-src")
    words = F.coalesce(script, default, F.array().cast("array<string>"))
    inline = F.array_contains(words, "'unsafe-inline'")
    nonce = F.exists(words, lambda w: w.startswith("'nonce-"))
    dynamic = F.array_contains(words, "'strict-dynamic'")
    return F.when(
        policy.isNotNull(),
        F.struct(
            script.isNotNull().alias("has_script_src"),
            default.isNotNull().alias("has_default_src"),
            (script.isNull() & default.isNull()).alias("no_script_restriction"),
            (inline & ~nonce & ~dynamic).alias("has_unsafe_inline"),
            F.array_contains(words, "'unsafe-eval'").alias("has_unsafe_eval"),
            nonce.alias("has_nonce"),
            dynamic.alias("has_strict_dynamic"),
            F.lit(True).alias("analyzable"),
        ),
    )


def is_prohibited_cipher(name: Column | str) -> Column:
    return contains_any(F.upper(col(name)), fv.PROHIBITED_CIPHER_WORDS)


def is_weak_tls(version: Column | str) -> Column:
    return F.coalesce(col(version).isin(fv.WEAK_TLS_VERSIONS), F.lit(False))


def is_plaintext_type(sql_type: Column | str) -> Column:
    return col(sql_type).rlike(fv.PLAINTEXT_TYPE_PATTERN)


def field_class(name: Column | str) -> Column:
    """GENERIC_ID first, since `spanid` also contains `pan`; then PAN, then SECRET."""
    norm = normalize_name(name)
    return (
        F.when(contains_any(norm, fv.LOG_GENERIC_ID_WORDS), F.lit("GENERIC_ID"))
        .when(contains_any(norm, fv.LOG_PAN_WORDS), F.lit("PAN"))
        .when(contains_any(norm, fv.LOG_SECRET_WORDS), F.lit("SECRET"))
        .otherwise(F.lit("NONE"))
    )


def is_safe_log_field(name: Column | str) -> Column:
    return F.lower(col(name)).isin(fv.SAFE_LOG_FIELDS)


def name_has(name: Column, words) -> Column:
    """Case-insensitive substring test against a word list."""
    return F.lower(name).rlike(any_of(words))
