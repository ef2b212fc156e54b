"""The headline query: scan several tables, then judge every requirement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.operators.requirements import requirement_status
from sievelake.plans.registry import run_scans
from workload import queries as q
from workload.views import view


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = run_scans(
        {
            "units": q.document_units(spark, sf_dir).unionByName(q.conversation_units(spark, sf_dir)),
            "kv": q.kv(spark, sf_dir),
            "urls": q.page_urls(spark, sf_dir),
            "pages": view(spark, sf_dir, "v_pages_aug"),
        }
    )
    return requirement_status(view(spark, sf_dir, "v_requirements"), findings)
