"""Card numbers and cardholder-data names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of, col, normalize_name
from sievelake.schemas import text_list


def extract_digits(value: Column | str) -> Column:
    return F.regexp_replace(col(value), "[^0-9]", "")


def luhn_valid(value: Column | str) -> Column:
    """13 to 19 digits that pass the mod-10 check."""
    value = col(value)
    shape = value.rlike(f"^[0-9]{{{fv.PAN_MIN_DIGITS},{fv.PAN_MAX_DIGITS}}}$")
    return F.coalesce(F.when(shape, F.call_function("luhn_check", value)).otherwise(F.lit(False)), F.lit(False))


def card_brand(value: Column | str) -> Column:
    """Issuer brand by leading digits and length; null when none fits."""
    value = col(value)
    result = None
    for brand, digits, low, high, lengths in fv.CARD_BRANDS:
        prefix = F.substring(value, 1, digits).try_cast("int")
        fits = prefix.between(low, high) & F.length(value).isin(lengths)
        result = F.when(fits, F.lit(brand)) if result is None else result.when(fits, F.lit(brand))
    return result


def is_likely_pan(value: Column | str) -> Column:
    return luhn_valid(value) & card_brand(value).isNotNull()


def is_sensitive_keyword(name: Column | str) -> Column:
    return normalize_name(name).isin(fv.SENSITIVE_KEYWORDS)


def has_test_prefix(name: Column | str) -> Column:
    return F.lower(col(name)).rlike(f"^({any_of(fv.TEST_PREFIXES)})")


def classify_pan_sad(name: Column | str) -> Column:
    """SAD before PAN, otherwise UNKNOWN."""
    name = col(name)
    return (
        F.when(name.rlike(fv.SAD_NAME_PATTERN), F.lit("SAD"))
        .when(name.rlike(fv.PAN_NAME_PATTERN), F.lit("PAN"))
        .otherwise(F.lit("UNKNOWN"))
    )


def requirement_for(kind: Column, context: str) -> Column:
    """Requirement and related ones for a data kind seen in a `field` or a `logger`.

    Anything that is not clearly a PAN is treated as SAD.
    """
    pan_related = {"field": [], "logger": ["3.4.1", "10.2.1"]}[context]
    return F.struct(
        F.when(kind == "PAN", F.lit("3.5.1")).otherwise(F.lit("3.3.1")).alias("requirement_id"),
        F.when(kind == "PAN", text_list(pan_related)).otherwise(text_list(["3.3.1.2"])).alias("related"),
    )
