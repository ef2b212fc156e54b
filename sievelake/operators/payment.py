"""Which entities belong to payment processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import fixed_values as fv
from sievelake.functions.policies import name_has
from sievelake.functions.text import any_of
from sievelake.operators.groups import attach_group_facts


def payment_context_score(entities: DataFrame) -> DataFrame:
    """Add score, fired signals and in_scope to (name, dir, import_path, type_name, field_name) rows."""
    folder = F.lower("dir")
    folder = F.when(folder.startswith("/"), folder).otherwise(F.concat(F.lit("/"), folder))
    signals = [
        ("name", 2, name_has(F.col("name"), fv.PAYMENT_NAME_WORDS)),
        ("path", 2, folder.rlike(any_of(fv.PAYMENT_DIR_SEGMENTS)) & (F.col("dir") != "")),
        ("sdk", 3, name_has(F.col("import_path"), fv.PAYMENT_SDK_WORDS)),
        ("chd-param", 2, name_has(F.col("type_name"), fv.CARD_TYPE_WORDS)),
        ("chd-field", 2, name_has(F.col("field_name"), fv.CARD_FIELD_WORDS)),
        ("internal-import", 2, name_has(F.col("import_path"), fv.PAYMENT_DIR_SEGMENTS)),
    ]
    score = F.lit(0)
    for _, weight, fired in signals:
        score = score + F.when(fired, F.lit(weight)).otherwise(F.lit(0))
    fired_names = F.filter(
        F.array(*[F.when(fired, F.lit(name)) for name, _, fired in signals]), lambda s: s.isNotNull()
    )
    return (
        entities.withColumn("score", score)
        .withColumn("signals", fired_names)
        .withColumn("in_scope", F.col("score") >= fv.PAYMENT_SCORE_THRESHOLD)
    )


def is_first_tier(name: Column) -> Column:
    return name_has(name, fv.TIER_1_WORDS)


def tier_of(name: Column, group_has_first: Column) -> Column:
    return (
        F.when(is_first_tier(name), F.lit(1))
        .when(name_has(name, fv.TIER_2_WORDS), F.lit(2))
        .when(group_has_first & name_has(name, fv.TIER_3_WORDS), F.lit(3))
        .otherwise(F.lit(0))
    )


def payment_tier(entities: DataFrame, group: str = "grp", name: str = "name") -> DataFrame:
    """Add tier 1, 2, 3 or 0. Tier 3 needs a tier 1 entity in the same group."""
    facts = attach_group_facts(entities, [group], _has_first=F.bool_or(is_first_tier(F.col(name))))
    return facts.withColumn("tier", tier_of(F.col(name), F.col("_has_first"))).drop("_has_first")
