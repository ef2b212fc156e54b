"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR    folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS      local threads (default 8)
BENCH_QUERIES   comma-separated name prefixes; "all" for every query
"""

from __future__ import annotations

import json
import os
import sys
import time

from sievelake.session import build_session
from workload.queries import QUERIES

# One or more per operator family, chosen for the work they do on the large tables.
HEADLINE = [
    "src01_read_units",
    "src04_to_lines",
    "src06_flatten_json",
    "src08_script_tags",
    "fn02_extract_digits",
    "fn06_shannon_entropy",
    "r01_scan_pan_literals",
    "r05_scan_secrets",
    "r06_scan_hardcoded_keys",
    "r09_scan_weak_hash",
    "r10_scan_scripts",
    "r15_scan_schema_columns",
    "r16_scan_retention_groups",
    "r17_audit_trail_coverage",
    "r18_audit_field_coverage",
    "r19_scan_log_fields",
    "r22_license_inventory",
    "j01_match_advisories",
    "j02_scan_dependencies",
    "j04_apply_suppressions",
    "j05_inline_suppressions",
    "j08_flow_reaches",
    "j10_snippets",
    "j11_diff_findings",
    "a03_findings_by_rule",
    "a06_propagate_related",
    "a09_alias_groups",
    "a12_sbom_inventory",
    "w01_top_n_per_severity",
    "w02_sort_by_severity",
    "w03_paginate",
    "w05_dedup_paired",
    "s01_run_scans",
    "s04_triage",
    "report_requirement_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    if chosen == "all":
        names = list(QUERIES)
    elif chosen:
        names = [n for n in QUERIES if n.startswith(tuple(chosen.split(",")))]
    else:
        names = HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.log.level": "ERROR"},
    )
    # Start the JVM's readers, shuffle and code generator before the first timed query.
    _run(QUERIES["a01_severity_counts"], spark, sf_dir)
    seconds, rates = {}, {}
    for name in names:
        begun = time.perf_counter()
        before = _rows_read(spark)
        rows = _run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(time.perf_counter() - begun, 3)
        read = _rows_read(spark) - before
        rates[name] = round(read / seconds[name]) if seconds[name] else read
        print(f"{name:32s} {seconds[name]:8.2f}s {read:10d} rows in {rows:10d} rows out", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


def _rows_read(spark) -> int:
    """Rows that all scans so far have read, from the status that Spark keeps of its stages."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))


def _run(build, spark, sf_dir: str) -> int:
    """Produce every column of every row without collecting them; the row count rides along."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    result = build(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    result.write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


if __name__ == "__main__":
    main()
