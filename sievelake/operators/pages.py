"""Script integrity and content policy of web pages and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.policies import parse_csp
from sievelake.functions.text import has_segment
from sievelake.schemas import emit, finding
from sievelake.sources.pages import meta_csp_value, payment_form, script_elements

SCANNER = "scripts"


def _at_line(outcome: Column, line_no: Column) -> Column:
    return outcome.withField("line_no", line_no.cast("int"))


def _script_outcomes(scripts: Column, payment: Column) -> Column:
    suffix = F.when(payment, F.lit("-PAYMENT")).otherwise(F.lit(""))
    severity = F.when(payment, F.lit("CRITICAL")).otherwise(F.lit("HIGH"))

    def outcome(tag: Column) -> Column:
        rule = F.when(tag["has_src"] & ~tag["has_integrity"], F.lit("SRI-MISSING")).when(
            ~tag["has_src"] & ~tag["has_nonce"], F.lit("NONCE-MISSING")
        )
        made = finding(
            F.concat(rule, suffix),
            severity,
            "6.4.3",
            subject=F.when(tag["has_src"], tag["src"]),
            description="Script is neither integrity-checked nor authorised",
            suggestion="Add an integrity hash to external and a nonce to inline scripts",
        )
        return F.when(rule.isNotNull(), _at_line(made, tag["line_no"]))

    monitoring = _at_line(
        finding(
            "FIM-REQUIRED",
            "MEDIUM",
            "11.6.1",
            description="Payment page needs change detection for its scripts",
            suggestion="Monitor the served files for changes",
        ),
        F.lit(1),
    )
    found = F.filter(F.transform(scripts, outcome), lambda o: o.isNotNull())
    return F.when(payment, F.concat(found, F.array(monitoring))).otherwise(found)


def _meta_outcomes(policy: Column) -> Column:
    flags = parse_csp(policy)
    unsafe = flags["has_unsafe_inline"] | flags["has_unsafe_eval"]
    made = _at_line(
        finding(
            F.when(unsafe, F.lit("META-CSP-UNSAFE")).otherwise(F.lit("META-CSP-ONLY")),
            F.when(unsafe, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
            "6.4.3",
            description="Policy is set in the page instead of the response header",
            suggestion="Send the policy as a response header without unsafe sources",
        ),
        F.lit(None),
    )
    return F.filter(F.array(F.when(policy.isNotNull(), made)), lambda o: o.isNotNull())


def _explode_outcomes(pages: DataFrame, key: str, path: str, outcomes: Column) -> DataFrame:
    rows = pages.select(F.col(key).cast("string").alias("record_id"), F.col(path).alias("path"), F.inline(outcomes))
    return rows.withColumn("scanner", F.lit(SCANNER))


def scan_scripts(pages: DataFrame, key: str = "page_id", path: str = "url", html: str = "html") -> DataFrame:
    """SRI, nonce and monitoring findings. Tags and page facts come from one pass over the page."""
    text = F.col(html)
    return _explode_outcomes(
        pages.withColumn("_payment", payment_form(text)),
        key,
        path,
        _script_outcomes(script_elements(text), F.col("_payment")),
    )


def scan_meta_csp(pages: DataFrame, key: str = "page_id", path: str = "url", html: str = "html") -> DataFrame:
    policy = pages.withColumn("_policy", meta_csp_value(F.col(html))).filter(F.col("_policy").isNotNull())
    return _explode_outcomes(policy, key, path, _meta_outcomes(F.col("_policy")))


def scan_pages(pages: DataFrame, key: str = "page_id", path: str = "url", html: str = "html") -> DataFrame:
    """Both page rules in a single scan of the page table."""
    text = F.col(html)
    rows = pages.withColumn("_payment", payment_form(text)).withColumn("_policy", meta_csp_value(text))
    outcomes = F.concat(
        _script_outcomes(script_elements(text), F.col("_payment")), _meta_outcomes(F.col("_policy"))
    )
    return _explode_outcomes(rows, key, path, outcomes)


def is_callback(path: Column) -> Column:
    """Server-to-server endpoints that never render a page."""
    return has_segment(F.coalesce(path, F.lit("")), fv.CALLBACK_SEGMENTS) | F.lower(path).endswith("callback")


def scan_csp_headers(responses: DataFrame) -> DataFrame:
    """Policy findings per response (record_id, path, response_type, csp).

    JSON responses need no policy. A policy holding a template marker cannot be
    judged. Otherwise every defect gives one row, and none gives CSP-OK.
    """
    rows = (
        responses.filter(F.col("response_type") != "json")
        .withColumn("_template", F.col("csp").rlike(r"\{\{|\$\{"))
        .withColumn("_flags", parse_csp(F.when(~F.col("_template"), F.col("csp"))))
    )
    flags, html = F.col("_flags"), F.col("response_type") == "html"
    inline, evaluation, unrestricted = (
        flags["has_unsafe_inline"],
        flags["has_unsafe_eval"],
        flags["no_script_restriction"],
    )
    judged = flags.isNotNull()

    def rule(rule_id, severity, description, suggestion):
        return finding(rule_id, severity, "6.4.3", description=description, suggestion=suggestion)

    return emit(
        rows,
        SCANNER,
        [
            (
                F.col("csp").isNull() & (html | ~F.coalesce(is_callback(F.col("path")), F.lit(False))),
                rule(
                    "CSP-MISSING",
                    F.when(html, F.lit("HIGH")).otherwise(F.lit("INFO")),
                    "Response has no content policy",
                    "Send a policy that restricts script sources",
                ),
            ),
            (
                F.coalesce(F.col("_template"), F.lit(False)),
                rule("CSP-VALUE-UNANALYZABLE", "INFO", "Policy is built at run time", "Review the policy by hand"),
            ),
            (
                judged & inline,
                rule("CSP-UNSAFE-INLINE", "HIGH", "Policy allows inline scripts", "Use nonces or hashes"),
            ),
            (judged & evaluation, rule("CSP-UNSAFE-EVAL", "HIGH", "Policy allows eval", "Remove unsafe-eval")),
            (
                judged & unrestricted,
                rule("CSP-NO-SCRIPT-SRC", "HIGH", "Policy does not restrict scripts", "Add script-src"),
            ),
            (
                judged & ~inline & ~evaluation & ~unrestricted,
                rule("CSP-OK", "INFO", "Policy restricts scripts", "Keep a script inventory as well"),
            ),
        ],
    )
