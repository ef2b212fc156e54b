"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist findings by severity. Rows are not regrouped: each task writes its own files."""
    findings.write.format(fmt).mode(mode).partitionBy("severity").save(path)


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("finding"))
