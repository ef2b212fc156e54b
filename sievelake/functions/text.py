"""String helpers shared by the scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(words) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def contains_any(value: Column, words) -> Column:
    """True when `value` contains one of `words`. One compiled regex per expression."""
    return value.rlike(any_of(words))


def has_segment(path: Column, segments) -> Column:
    """True when a '/'-separated segment of the lower-cased path is one of `segments`."""
    return F.lower(path).rlike(rf"(^|/)({any_of(segments)})(/|$)")


def normalize_name(name: Column | str) -> Column:
    """Drop '_' and '-', lower-case."""
    return F.lower(F.translate(col(name), "_-", ""))


def last_segment(key: Column | str) -> Column:
    """Text after the last dot of a dotted key."""
    return F.substring_index(col(key), ".", -1)


def parent_key(key: Column | str) -> Column:
    """Text before the last dot; the key itself when it has none."""
    key = col(key)
    return F.when(F.instr(key, ".") > 0, F.regexp_replace(key, r"\.[^.]*$", "")).otherwise(key)


def strip(value: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(value, F.lit(" \t\r\n\f"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def look_up(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a small fixed table; the key expression is evaluated once."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
