"""Lock files and vulnerability advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import strip
from sievelake.schemas import ADVISORY

MOD_SUFFIX = "/go.mod"


def lock_entries(lines: DataFrame, line: str = "line", keep=("project_id",)) -> DataFrame:
    """Three-field lock lines as (keep..., module, version, hash, mod_only)."""
    parts = F.split(strip(F.col(line)), r"[ \t]+")
    rows = lines.select(*keep, parts.alias("_p")).filter(F.size("_p") == 3)
    version = F.col("_p")[1]
    mod_only = version.endswith(MOD_SUFFIX)
    return rows.select(
        *keep,
        F.col("_p")[0].alias("module"),
        F.when(mod_only, F.regexp_replace(version, f"{MOD_SUFFIX}$", "")).otherwise(version).alias("version"),
        F.col("_p")[2].alias("hash"),
        mod_only.alias("mod_only"),
    )


def read_advisories(spark, path: str) -> DataFrame:
    """Advisory documents, one JSON object per line; the schema is fixed, never inferred."""
    return spark.read.schema(ADVISORY).json(path)


def parse_advisories(df: DataFrame, json: str) -> DataFrame:
    return df.select(F.from_json(F.col(json), ADVISORY).alias("_a")).select("_a.*")


def explode_advisories(advisories: DataFrame) -> DataFrame:
    """One row per version event, keeping the listed order of ranges and events."""
    ranges = advisories.select(
        F.col("id").alias("adv_id"), F.posexplode("affected").alias("affected_no", "_affected")
    ).select(
        "adv_id",
        "affected_no",
        F.col("_affected.package.name").alias("package"),
        F.posexplode("_affected.ranges").alias("range_no", "_range"),
    )
    return ranges.select(
        "adv_id",
        "package",
        "affected_no",
        "range_no",
        F.col("_range.type").alias("range_type"),
        F.posexplode("_range.events").alias("event_no", "_event"),
    ).select("adv_id", "package", "affected_no", "range_no", "range_type", "event_no", "_event.introduced", "_event.fixed")


def flat_advisories(advisories: DataFrame) -> DataFrame:
    """One row per advisory and affected package, events kept as an ordered array.

    This is the shape the matcher joins on: (adv_id, affected_no, package, ranges, labels).
    """
    base = advisories.select(
        F.col("id").alias("adv_id"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("database_specific.severity").alias("db_severity"),
        F.get(F.col("severity"), F.lit(0))["score"].alias("cvss"),
        "summary",
        F.posexplode("affected").alias("affected_no", "_affected"),
    )
    return base.select(
        "adv_id",
        "aliases",
        "db_severity",
        "cvss",
        "summary",
        "affected_no",
        F.col("_affected.package.name").alias("package"),
        F.col("_affected.ranges").alias("ranges"),
    )


def single_range(introduced: Column, fixed: Column) -> Column:
    """A `ranges` value with one semantic range, for flat advisory tables."""
    events = F.filter(
        F.array(
            F.struct(introduced.alias("introduced"), F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected")),
            F.struct(F.lit(None).cast("string").alias("introduced"), fixed.alias("fixed"), F.lit(None).cast("string").alias("last_affected")),
        ),
        lambda e: e["introduced"].isNotNull() | e["fixed"].isNotNull(),
    )
    return F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events")))
