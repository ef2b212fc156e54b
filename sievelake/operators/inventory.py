"""Component inventories from lock entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.versions import h1_to_hex, purl
from sievelake.operators.groups import join_lookup


def sbom_inventory(entries: DataFrame, declared: DataFrame, order: str = "ord") -> DataFrame:
    """Components per project with purl, SHA-256 and direct or indirect use.

    A content hash is preferred over a manifest-only hash. `declared` has
    (project_id, module, version, indirect, ord); its last declaration counts.
    """
    keys = ["project_id", "module", "version"]
    components = entries.groupBy(*keys).agg(
        F.max(F.when(~F.col("mod_only"), F.col("hash"))).alias("_content"),
        F.max(F.when(F.col("mod_only"), F.col("hash"))).alias("_manifest"),
    )
    usage = declared.groupBy(*keys).agg(F.max_by("indirect", order).alias("indirect"))
    return components.join(usage, keys, "left").select(
        *keys,
        purl("module", "version").alias("purl"),
        h1_to_hex(F.coalesce("_content", "_manifest")).alias("sha256"),
        F.coalesce("indirect", F.lit(False)).alias("indirect"),
    )


def inventory_status(projects: DataFrame, components: DataFrame, licences: DataFrame) -> DataFrame:
    """PASS with the component count, or FAIL for a missing or empty inventory, per project.

    `licences` has (module, licence); components without one are counted.
    """
    known = licences.select("module").distinct().withColumn("_known", F.lit(True))
    used = components.groupBy("project_id", "module").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        join_lookup(used, known, ["module"])
        .groupBy("project_id")
        .agg(
            F.sum("_n").alias("component_count"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("unknown_licences"),
        )
    )
    joined = projects.select("project_id").distinct().join(counts, "project_id", "left")
    return joined.select(
        "project_id",
        F.when(F.coalesce("component_count", F.lit(0)) > 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.coalesce("component_count", F.lit(0)).cast("bigint").alias("component_count"),
        F.coalesce("unknown_licences", F.lit(0)).cast("bigint").alias("unknown_licences"),
    )
