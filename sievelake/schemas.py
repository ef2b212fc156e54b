"""Row shapes exchanged by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)

SNIPPET = T.StructType(
    [
        T.StructField("before", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("after", T.StringType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("requirement_id", T.StringType(), False),
        T.StructField("scanner", T.StringType(), False),
        T.StructField("record_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("col_no", T.IntegerType()),
        T.StructField("subject", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("related_requirements", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
        T.StructField("dev_context", T.BooleanType()),
        T.StructField("triage_hint", T.StringType()),
        T.StructField("code_snippet", SNIPPET),
    ]
)

# OSV-style advisory documents; field names are the public exchange format.
ADVISORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField(
            "severity",
            T.ArrayType(
                T.StructType([T.StructField("type", T.StringType()), T.StructField("score", T.StringType())])
            ),
        ),
        T.StructField("database_specific", T.StructType([T.StructField("severity", T.StringType())])),
        T.StructField(
            "affected",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "package",
                            T.StructType(
                                [T.StructField("name", T.StringType()), T.StructField("ecosystem", T.StringType())]
                            ),
                        ),
                        T.StructField(
                            "ranges",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("type", T.StringType()),
                                        T.StructField(
                                            "events",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("introduced", T.StringType()),
                                                        T.StructField("fixed", T.StringType()),
                                                        T.StructField("last_affected", T.StringType()),
                                                    ]
                                                )
                                            ),
                                        ),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("versions", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def text_list(values) -> Column:
    """Array literal of strings, typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def as_findings(df: DataFrame, keep=()) -> DataFrame:
    """Project `df` onto the FINDING shape and the columns to `keep`, filling what a rule leaves out."""
    present = dict(df.dtypes)
    defaults = {"related_requirements": "array()", "dev_context": "false"}
    columns = []
    for field in FINDING.fields:
        kind = field.dataType.simpleString()
        if present.get(field.name) == kind:
            columns.append(field.name)
        else:
            value = field.name if field.name in present else defaults.get(field.name, "NULL")
            columns.append(f"CAST({value} AS {kind}) AS {field.name}")
    return df.selectExpr(*columns, *keep)


def finding(
    rule_id,
    severity,
    requirement_id,
    *,
    related=(),
    subject=None,
    description=None,
    suggestion=None,
    confidence=None,
    triage_hint=None,
    dev_context=None,
    scanner=None,
) -> Column:
    """One rule outcome as a struct, for rules that emit several rows per input row."""

    def col(value, kind="string"):
        if value is None:
            return F.lit(None).cast(kind)
        return value if isinstance(value, Column) else F.lit(value).cast(kind)

    return F.struct(
        col(rule_id).alias("rule_id"),
        col(severity).alias("severity"),
        col(requirement_id).alias("requirement_id"),
        (related if isinstance(related, Column) else text_list(related)).alias("related_requirements"),
        col(subject).alias("subject"),
        col(description).alias("description"),
        col(suggestion).alias("suggestion"),
        col(confidence).alias("confidence"),
        col(triage_hint).alias("triage_hint"),
        (F.lit(False) if dev_context is None else dev_context).alias("dev_context"),
        col(scanner).alias("scanner"),
    )


def when_true(outcomes: list[tuple[Column, Column]]) -> Column:
    """Array with the outcomes whose condition holds, and null for the others."""
    return F.array(*[F.when(condition, outcome) for condition, outcome in outcomes])


@dataclass(frozen=True)
class RowRule:
    """A rule that looks at one row at a time.

    `stages` name intermediate columns, level by level, so that a costly value
    used in several places is computed once. `found` is an array of findings,
    in which null stands for an outcome that did not occur.
    """

    found: Column
    stages: tuple[dict[str, Column], ...] = ()


PLACE_COLUMNS = ("record_id", "path", "line_no", "col_no")


def apply_rules(df: DataFrame, rules: list[RowRule], keep=()) -> DataFrame:
    """Run any number of row rules in one pass over `df`: no shuffle, one scan.

    Nulls are dropped after the explode: a plain filter stays in generated code,
    where a filter on the array would evaluate every condition outside it.
    """
    carried = [c for c in (*PLACE_COLUMNS, *keep) if c in df.columns]
    for level in range(max(len(rule.stages) for rule in rules)):
        named = {k: v for rule in rules if level < len(rule.stages) for k, v in rule.stages[level].items()}
        df = df.withColumns(named)
    found = rules[0].found if len(rules) == 1 else F.concat(*[rule.found for rule in rules])
    return df.select(*carried, F.inline(found)).filter(F.col("rule_id").isNotNull())


def emit(df: DataFrame, scanner: str, outcomes: list[tuple[Column, Column]], keep=()) -> DataFrame:
    """Rows for the outcomes whose condition holds. One pass over `df`, no shuffle."""
    return apply_rules(df, [RowRule(when_true(outcomes))], keep).withColumn("scanner", F.lit(scanner))
