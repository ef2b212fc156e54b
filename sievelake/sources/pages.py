"""Tags of web pages that matter for script integrity and content policy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of

# Attributes of a tag: quoted values may hold '>', so they are matched as units.
TAG_ATTRIBUTES = r"""((?:[\s/][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?)"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
SCRIPT = rf"(?is)<script{TAG_ATTRIBUTES}>.*?(?:</script|\z)"
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def without_script_bodies(html: Column) -> Column:
    return F.regexp_replace(without_comments(html), SCRIPT, "<script$1>")


def tag_attributes(html: Column, names: str) -> Column:
    """Attribute text of every start tag whose name matches the alternation."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names}){TAG_ATTRIBUTES}>"), 1)


def attribute(attrs: Column, name: str) -> Column:
    """Unquoted value of an attribute; '' when bare, null when absent. The last one counts.

    Attribute text that never spells the name is not taken apart.
    """
    names = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), 1)
    values = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), 2)
    pairs = F.filter(
        F.arrays_zip(names.alias("name"), values.alias("value")), lambda p: F.lower(p["name"]) == name
    )
    raw = F.try_element_at(pairs, F.lit(-1))["value"]
    return F.when(attrs.rlike(f"(?i){re.escape(name)}"), F.regexp_replace(raw, """^["']|["']$""", ""))


def script_elements(html: Column) -> Column:
    """Array of script elements of a page with 1-based position and line.

    An empty src counts as inline. The line is that of the element's own
    occurrence of '<script'; 0 when the page spells the tag differently.
    """
    tags = F.regexp_extract_all(without_comments(html), F.lit(SCRIPT), 1)
    breaks = F.transform(
        F.split(html, "<script"), lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    )

    def element(attrs: Column, index: Column) -> Column:
        src = F.coalesce(attribute(attrs, "src"), F.lit(""))
        before = F.aggregate(F.slice(breaks, F.lit(1), index + 1), F.lit(0), lambda acc, n: acc + n)
        return F.struct(
            (index + 1).alias("pos"),
            src.alias("src"),
            (src != "").alias("has_src"),
            attribute(attrs, "integrity").isNotNull().alias("has_integrity"),
            attribute(attrs, "nonce").isNotNull().alias("has_nonce"),
            F.when(index + 1 < F.size(breaks), before + 1).otherwise(F.lit(0)).alias("line_no"),
        )

    return F.transform(tags, element)


def script_tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per script element. Narrow: one pass over each page."""
    with_scripts = pages.filter(F.col(html).rlike("(?i)<script"))
    return with_scripts.select(key, F.inline(script_elements(F.col(html))))


def meta_csp_value(html: Column) -> Column:
    """Content of the last policy meta tag that has one; null when there is none."""
    metas = F.transform(
        tag_attributes(without_script_bodies(html), "meta"),
        lambda a: F.when(F.lower(attribute(a, "http-equiv")) == "content-security-policy", attribute(a, "content")),
    )
    found = F.try_element_at(F.filter(metas, lambda c: c.isNotNull()), F.lit(-1))
    # Pages that never name the policy skip the tag scan.
    return F.when(html.rlike("(?i)content-security-policy"), found)


def payment_form(html: Column) -> Column:
    """True when a form or input attribute names payment data."""
    words = f"(?i)({any_of(fv.PAYMENT_FORM_WORDS)})"

    def names_payment(attrs: Column) -> Column:
        hit = F.lit(False)
        for name in fv.PAYMENT_FORM_ATTRIBUTES:
            hit = hit | F.coalesce(attribute(attrs, name).rlike(words), F.lit(False))
        # The words must occur somewhere in the tag before its attributes are read.
        return attrs.rlike(words) & hit

    found = F.exists(tag_attributes(without_script_bodies(html), "form|input"), names_payment)
    return F.coalesce(F.when(html.rlike("(?i)<(form|input)"), found), F.lit(False))


def meta_csp(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, meta_csp_value(F.col(html)).alias("csp")).filter(F.col("csp").isNotNull())


def payment_form_flag(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, payment_form(F.col(html)).alias("is_payment"))
