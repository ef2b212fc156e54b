"""What a path tells about a record: environment, location, scope, glob matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.severity import severity_rank
from sievelake.functions.text import any_of, base_name, col, extension, has_segment, look_up


def is_prod_path(path: Column) -> Column:
    lower = F.lower(path)
    return (
        has_segment(path, fv.PROD_SEGMENTS)
        | base_name(lower).isin(fv.PROD_FILES)
        | lower.rlike(any_of(fv.PROD_PREFIXES))
    )


def is_dev_path(path: Column) -> Column:
    return has_segment(path, fv.DEV_SEGMENTS) | base_name(F.lower(path)).rlike(f"^({any_of(fv.DEV_FILE_PREFIXES)})")


def is_dedicated_dev(path: Column) -> Column:
    return has_segment(path, fv.DEDICATED_DEV_SEGMENTS)


def dev_context(path: Column | str, value: Column | str, severity: Column | str) -> Column:
    """Severity after looking at the environment the record lives in.

    Production paths are CRITICAL whatever else holds. Dedicated development
    folders are INFO. Otherwise dev paths and placeholder values lower, never
    raise, the severity. Null paths and values count as neither.
    """
    path = F.coalesce(col(path), F.lit(""))
    value = F.coalesce(col(value), F.lit(""))
    severity = col(severity)
    prod = is_prod_path(path)
    dev = is_dev_path(path)
    dedicated = is_dedicated_dev(path)
    placeholder = F.lower(value).isin(fv.DEV_PLACEHOLDERS)
    lowered = (
        F.when(dev & placeholder, F.lit("INFO"))
        .when(dev | placeholder, F.lit("MEDIUM"))
        .otherwise(severity)
    )
    adjusted = F.when(severity_rank(lowered) < severity_rank(severity), lowered).otherwise(severity)
    final = F.when(prod, F.lit("CRITICAL")).when(dedicated, F.lit("INFO")).otherwise(adjusted)
    return F.struct(
        final.alias("severity"),
        (~prod & (dedicated | dev | placeholder)).alias("dev_context"),
        F.when(~prod & (dev | placeholder), F.lit("dev-context")).otherwise(F.lit("")).alias("label"),
        (~prod & dedicated & has_segment(path, fv.EXAMPLE_SEGMENTS)).alias("examples"),
    )


def file_location(path: Column | str) -> Column:
    """Label of the first segment that names a known kind of folder; '' if none."""
    labels = {name: label for names, label in fv.LOCATION_LABELS for name in names}
    # The leftmost match is the first such segment.
    first = F.regexp_extract(F.lower(col(path)), rf"(^|/)({any_of(labels)})(/|$)", 2)
    return look_up(first, labels, "")


def glob_regex(pattern: str) -> str:
    """Regex for a shell glob: '*' and '?' stay within one segment."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        closing = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif closing > 0:
            out.append("[" + pattern[i + 1 : closing].replace("\\", "\\\\") + "]")
            i = closing
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def glob_regex_of(glob: Column) -> Column:
    """The translation of glob_regex() for globs in a column."""

    def quoted(text: Column) -> Column:
        return F.concat(F.lit("\\Q"), text, F.lit("\\E"))

    def part(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        return (
            F.when(token == "*", F.lit("[^/]*"))
            .when(token == "?", F.lit("[^/]"))
            .when((F.length(token) > 1) & token.startswith("["), F.concat(F.lit("["), F.replace(inner, F.lit("\\"), F.lit("\\\\")), F.lit("]")))
            .when((F.length(token) > 1) & token.startswith("\\"), quoted(F.substr(token, F.lit(2))))
            .otherwise(quoted(token))
        )

    tokens = F.regexp_extract_all(glob, F.lit(r"\[[\s\S][^\]]*\]|\\[\s\S]|[\s\S]"), 0)
    return F.array_join(F.transform(tokens, part), "")


def rule_regex_of(pattern: Column) -> Column:
    """The translation of rule_regex() for patterns in a column."""
    prefix = F.substring_index(pattern, "**", 1)
    rest = F.substr(pattern, F.length(prefix) + 3)
    literal = F.array_join(F.transform(F.regexp_extract_all(prefix, F.lit(r"[\s\S]"), 0), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "")
    return (
        F.when(~pattern.contains("**"), F.concat(F.lit("^"), glob_regex_of(pattern), F.lit("$")))
        .when(rest.isin("", "/"), F.concat(F.lit("^"), literal))
        .otherwise(F.concat(F.lit("^"), literal, F.lit("(.*/)?"), glob_regex_of(F.substr(rest, F.lit(2))), F.lit("$")))
    )


def rule_regex(pattern: str) -> str:
    """Full-path regex of a rule pattern; a '**' splits it into path prefix and file glob.

    Text before '**' is literal. Text after it, minus its leading slash, must
    match the base name of what follows the prefix.
    """
    if "**" not in pattern:
        return f"^{glob_regex(pattern)}$"
    prefix, rest = pattern.split("**", 1)
    if rest in ("", "/"):
        return f"^{re.escape(prefix)}"
    return f"^{re.escape(prefix)}(.*/)?{glob_regex(rest[1:])}$"


def glob_match(pattern: str, path: Column | str) -> Column:
    return col(path).rlike(rule_regex(pattern))


def link_window(line_no: Column | str, radius: int = fv.LINK_RADIUS) -> Column:
    line_no = col(line_no)
    start = F.greatest(line_no - radius, F.lit(1))
    return F.struct(start.alias("start_line"), F.greatest(line_no + radius, start).alias("end_line"))


def mime_type(path: Column | str) -> Column:
    types = {ext: mime for exts, mime in fv.MIME_TYPES for ext in exts}
    return look_up(extension(col(path)), types, fv.DEFAULT_MIME)


def is_payment_path(path: Column | str) -> Column:
    return has_segment(col(path), fv.PAYMENT_PATH_SEGMENTS)


def has_test_helper_segment(path: Column) -> Column:
    return has_segment(F.coalesce(path, F.lit("")), fv.TEST_HELPER_SEGMENTS)
