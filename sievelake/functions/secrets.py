"""Tests on configuration keys and values that tell secrets from ordinary data."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of, col, contains_any, last_segment, normalize_name


def shannon_entropy(value: Column | str) -> Column:
    """Bits per character; 0 for the empty string."""
    value = col(value)
    total = F.length(value).cast("double")
    counts = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda ch: (total - F.length(F.replace(value, ch, F.lit("")))) / total,
    )
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(total > 0, bits).otherwise(F.lit(0.0))


def is_high_entropy(value: Column | str) -> Column:
    """The length test comes first, so short values never pay for the entropy."""
    value = col(value)
    long_enough = F.octet_length(value) >= fv.ENTROPY_MIN_BYTES
    return F.when(long_enough, shannon_entropy(value) > fv.ENTROPY_THRESHOLD).otherwise(F.lit(False))


def is_basic_placeholder(value: Column | str) -> Column:
    value = col(value)
    return (
        (F.octet_length(value) < 4)
        | (value.startswith("<") & value.endswith(">"))
        | F.lower(value).isin(fv.PLACEHOLDER_VALUES)
    )


def has_placeholder_substring(value: Column | str) -> Column:
    return contains_any(F.lower(col(value)), fv.PLACEHOLDER_SUBSTRINGS)


def is_template_value(value: Column | str) -> Column:
    """`${...}` or nothing but x."""
    value = col(value)
    return (value.startswith("${") & value.endswith("}")) | value.rlike("^[xX]+$")


def is_password_placeholder(value: Column | str) -> Column:
    value = col(value)
    return (
        (value == "")
        | F.lower(value).isin(fv.PASSWORD_PLACEHOLDERS)
        | (value.startswith("<") & value.endswith(">"))
        | is_template_value(value)
    )


def placeholder_kind(value: Column | str) -> Column:
    return (
        F.when(is_basic_placeholder(value), F.lit("basic"))
        .when(has_placeholder_substring(value), F.lit("substring"))
        .when(is_template_value(value), F.lit("template"))
    )


def is_sql_text(value: Column | str) -> Column:
    return col(value).rlike(fv.SQL_TEXT_PATTERN)


def is_credential_key(key: Column | str) -> Column:
    words = [w.replace("_", "") for w in fv.CREDENTIAL_KEY_WORDS]
    return contains_any(normalize_name(last_segment(key)), words)


def is_path_or_url_value(value: Column | str) -> Column:
    value = col(value)
    relative = (
        value.rlike(fv.RELATIVE_PATH_PATTERN)
        & ~F.exists(F.split(value, "/"), lambda part: part.rlike(fv.LONG_TOKEN_SEGMENT_PATTERN))
    )
    return (
        (value != "")
        & ~value.rlike(fv.NOISE_CHARACTERS_PATTERN)
        & (
            value.rlike(fv.URL_SCHEME_PATTERN)
            | value.rlike(fv.FILE_PATH_PATTERN)
            | value.rlike(fv.HOSTNAME_PATTERN)
            | relative
        )
    )


def is_path_or_url_pair(key: Column | str, value: Column | str) -> Column:
    suffix = F.lower(last_segment(key)).rlike(f"({any_of(fv.PATH_URL_KEY_SUFFIXES)})$")
    return suffix & is_path_or_url_value(value)


def secret_prefix(value: Column | str) -> Column:
    """Name of the first known token prefix whose minimum length is met."""
    value = col(value)
    result = None
    for name, prefix, min_len in fv.SECRET_PREFIXES:
        hit = value.startswith(prefix) & (F.octet_length(value) >= min_len)
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return result


def is_connection_string(value: Column | str) -> Column:
    value = col(value)
    hit = value.rlike(fv.CONNECTION_STRING_PATTERNS[0])
    for pattern in fv.CONNECTION_STRING_PATTERNS[1:]:
        hit = hit | value.rlike(pattern)
    return hit


def is_non_secret(value: Column | str) -> Column:
    """Routing keys, URL paths, upper-case enums, short identifiers, error texts."""
    value = col(value)
    digits = F.octet_length(value) - F.octet_length(F.translate(value, "0123456789", ""))
    camel = (
        (F.octet_length(value) <= fv.CAMEL_MAX_BYTES)
        & value.rlike(fv.CAMEL_IDENTIFIER_PATTERN)
        & (digits <= fv.CAMEL_MAX_DIGITS)
    )
    return (
        value.rlike(fv.DOTTED_KEY_PATTERN)
        | value.rlike(fv.URL_PATH_PATTERN)
        | value.rlike(fv.UPPER_ENUM_PATTERN)
        | camel
        | F.lower(value).rlike(f"^({any_of(fv.ERROR_PREFIXES)})")
    )


def alphabet_runs() -> list[str]:
    """Every run of consecutive letters of the required length, both cases."""
    size = fv.ALPHABET_RUN
    return [
        letters[start : start + size]
        for letters in (string.ascii_uppercase, string.ascii_lowercase)
        for start in range(len(letters) - size + 1)
    ]


def is_character_set(value: Column | str) -> Column:
    """A generator alphabet: long, mostly distinct bytes, with an ordered run."""
    value = col(value)
    n_bytes = F.octet_length(value)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), 1)))
    ordered = value.rlike("|".join(["0123456789", *alphabet_runs()]))
    return (
        F.when(
            (n_bytes >= fv.CHARACTER_SET_MIN_BYTES) & ordered,
            distinct * 100 >= n_bytes * fv.CHARACTER_SET_PERCENT,
        )
        .otherwise(F.lit(False))
    )


def is_excluded_literal(value: Column | str) -> Column:
    value = col(value)
    return (
        (F.octet_length(value) < 8)
        | value.rlike(fv.SEMVER_PATTERN)
        | value.rlike(fv.URL_PATTERN)
        | value.rlike(fv.UUID_PATTERN)
    )
