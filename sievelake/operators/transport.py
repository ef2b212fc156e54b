"""TLS settings and password policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.policies import is_prohibited_cipher, is_weak_tls
from sievelake.schemas import RowRule, apply_rules, finding, when_true


def tls_rule() -> RowRule:
    def rule(rule_id, severity, description, related=(), subject=None) -> Column:
        return finding(
            rule_id,
            severity,
            "4.2.1",
            related=related,
            subject=subject,
            description=description,
            suggestion="Verify certificates and allow TLS 1.2 or later with authenticated ciphers",
            scanner="tls",
        )

    settings = when_true(
        [
            (
                F.col("skip_verify"),
                rule("TLS-INSECURE-SKIP-VERIFY", "CRITICAL", "Certificates are not verified", ["4.2.1.1", "2.2.7"]),
            ),
            (
                is_weak_tls("min_version"),
                rule("TLS-WEAK-VERSION", "CRITICAL", "Old protocol is allowed", subject=F.col("min_version")),
            ),
            (
                F.col("min_version").isNull(),
                rule("TLS-MISSING-MIN-VERSION", "HIGH", "No minimum protocol is set"),
            ),
        ]
    )
    bad = F.filter(F.coalesce("ciphers", F.array().cast("array<string>")), is_prohibited_cipher)
    ciphers = F.transform(bad, lambda name: rule("TLS-WEAK-CIPHER", "CRITICAL", "Cipher is prohibited", subject=name))
    return RowRule(F.concat(settings, ciphers))


def scan_tls_settings(settings: DataFrame) -> DataFrame:
    """Findings per service (record_id, skip_verify, min_version, ciphers array); one row per bad cipher."""
    return apply_rules(settings, [tls_rule()])


def password_policy_rule() -> RowRule:
    weak = F.col("min_password_len") < fv.PASSWORD_MIN_LENGTH
    short = finding(
        "AUTH-WEAK-POLICY",
        "CRITICAL",
        "8.3.6",
        subject=F.col("min_password_len").cast("string"),
        description="Minimum password length is too short",
        suggestion="Require at least 12 characters",
        scanner="auth",
    )
    counted = finding(
        "AUTH-BYTE-COUNT",
        "MEDIUM",
        "8.3.6",
        description="Password length is counted in bytes",
        suggestion="Count characters",
        scanner="auth",
    )
    return RowRule(when_true([(weak, short), (weak & (F.col("len_unit") == "bytes"), counted)]))


def scan_password_policy(settings: DataFrame) -> DataFrame:
    """Weak minimum lengths, and weak lengths that also count bytes."""
    return apply_rules(settings, [password_policy_rule()])
