"""Severity ranks and requirement categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.text import col


def severity_rank(severity: Column | str) -> Column:
    """5 for CRITICAL down to 1 for INFO; 0 for anything else."""
    severity = col(severity)
    result = None
    for position, name in enumerate(fv.SEVERITIES):
        rank = len(fv.SEVERITIES) - position
        result = F.when(severity == name, F.lit(rank)) if result is None else result.when(severity == name, F.lit(rank))
    return result.otherwise(F.lit(0))


def severity_order(severity: Column | str) -> Column:
    """Sort key: 0 for CRITICAL up to 4 for INFO, 5 for anything else."""
    return F.lit(len(fv.SEVERITIES)) - severity_rank(severity)


def severity_of_rank(rank: Column) -> Column:
    """Inverse of severity_rank for ranks 1 to 5."""
    names = F.array(*[F.lit(s) for s in reversed(fv.SEVERITIES)])
    return F.get(names, rank - 1)


def is_actionable(severity: Column | str) -> Column:
    return col(severity).isin("CRITICAL", "HIGH", "MEDIUM")


def requirement_category(requirement_id: Column | str) -> Column:
    return F.substring_index(col(requirement_id), ".", 1)
