"""Incremental scans: the row-local rules on a stream, as they are or with event time and state."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelake import fixed_values as fv
from sievelake.plans.registry import DEFAULT_RULES, run_scans
from sievelake.schemas import apply_rules, as_findings

EVENT_TIME, SLOT = "event_time", "slot"
#: What makes two findings the same; the other columns follow from these and the rule.
IDENTITY = ("rule_id", "severity", "record_id", "path", "line_no", "col_no", "subject", "dev_context", "triage_hint")


def scan_stream(records: dict[str, DataFrame], rules=DEFAULT_RULES) -> DataFrame:
    """Findings of a streaming input. Rules that need whole groups are left out."""
    local = tuple(rule for rule in rules if rule.row_local)
    return run_scans(records, local)


def timed_findings(records: Mapping[str, DataFrame], rules=DEFAULT_RULES, time: str = EVENT_TIME) -> DataFrame:
    """Findings with the event time of the record they come from, of every rule that can carry it.

    All inputs have the column `time`. Row rules over one input share its pass.
    """
    ready = [r for r in rules if r.row_local and set(r.needs) <= set(records)]
    built = []
    for name, prepare in dict.fromkeys((r.needs[0], r.prepare) for r in ready if r.row):
        rows = prepare(records[name], keep=(time,)) if prepare else records[name]
        built.append(apply_rules(rows, [r.row() for r in ready if r.row and (r.needs[0], r.prepare) == (name, prepare)], keep=(time,)))
    built += [r.timed(records[r.needs[0]], (time,)) for r in ready if r.timed]
    if not built:
        raise ValueError("no rule with event time for the given inputs")
    whole = reduce(DataFrame.unionByName, [as_findings(df, keep=(time,)) for df in built])
    return whole.withColumnRenamed(time, EVENT_TIME).withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp"))


def report_once(findings: DataFrame, reuse_minutes: int = fv.REUSE_MINUTES, delay_minutes: int = fv.REUSE_MINUTES) -> DataFrame:
    """One report of a finding for each slot of event time; what the same slot brings again is the result already reported.

    Slots are `reuse_minutes` long and start at whole multiples, so which findings come out does not depend on the order
    in which records arrive. Rows may be `delay_minutes` late, at least as long as a slot; later ones are dropped. The state
    holds one entry for each finding until the watermark has passed it by the delay, then forgets it. Findings without event
    time are reported each time. Adds `slot`, the start of the slot, in place of the event time.
    """
    if delay_minutes < reuse_minutes:
        raise ValueError("the allowed delay must be at least the time of reuse, or the state forgets a slot before it ends")
    slot = F.window(EVENT_TIME, f"{reuse_minutes} minutes")["start"]
    placed = findings.filter(F.col(EVENT_TIME).isNotNull()).withWatermark(EVENT_TIME, f"{delay_minutes} minutes").withColumn(SLOT, slot)
    once = placed.dropDuplicatesWithinWatermark([*IDENTITY, SLOT]).drop(EVENT_TIME)
    unplaced = findings.filter(F.col(EVENT_TIME).isNull()).withColumnRenamed(EVENT_TIME, SLOT)
    return once.unionByName(unplaced)


def append_findings(findings: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append findings to a parquet table with exactly-once file commits."""
    writer = findings.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def scan_available(
    spark: SparkSession,
    source: str,
    schema,
    prepare: Callable[[DataFrame], dict[str, DataFrame]],
    out: str,
    checkpoint: str,
    rules=DEFAULT_RULES,
    event_time: str | None = None,
    reuse_minutes: int = fv.REUSE_MINUTES,
    delay_minutes: int = fv.REUSE_MINUTES,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Scan the parquet files now present under `source` in micro-batches, then return the findings table.

    With the name of an event-time column, which all prepared inputs have, findings are reported once for each slot
    (report_once); the slots that are still open are in the checkpoint, so a later call goes on with them.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    prepared = prepare(stream)
    findings = report_once(timed_findings(prepared, rules, event_time), reuse_minutes, delay_minutes) if event_time else scan_stream(prepared, rules)
    query = append_findings(findings, out, checkpoint)
    query.awaitTermination()
    return spark.read.schema(findings.schema).parquet(out)
