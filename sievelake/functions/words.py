"""Words inside identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import any_of, col


def _separated(name: Column) -> Column:
    """Put '_' at camel-case and acronym boundaries; '-' becomes '_'."""
    marked = F.regexp_replace(name, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2")
    marked = F.regexp_replace(marked, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    return F.regexp_replace(marked, "[_-]+", "_")


def identifier_words(name: Column | str) -> Column:
    return F.filter(F.split(_separated(col(name)), "_"), lambda word: word != "")


def keyword_at_boundary(name: Column | str, keywords) -> Column:
    """A keyword is the whole name, its last word, or is followed by a value word.

    The words are joined by '_', so one regex covers all keywords and positions.
    """
    name = col(name)
    joined = F.regexp_replace(F.lower(_separated(name)), "^_|_$", "")
    words = any_of(keywords)
    suffixes = any_of(fv.VALUE_SUFFIX_WORDS)
    return joined.rlike(rf"(^|_)({words})($|_({suffixes})(_|$))") | F.lower(name).isin(list(keywords))
