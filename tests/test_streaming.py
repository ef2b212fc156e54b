from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelake.plans.registry import DEFAULT_RULES, run_scans
from sievelake.session import cut_lineage, scratch_path, shared_dir
from sievelake.streaming.scan_stream import append_findings, report_once, scan_available, scan_stream, timed_findings

ROWS = "record_id string, path string, line_no int, key string, value string, text string, url string"


def inputs(df):
    """Every row-local input kind from one record table."""
    return {
        "kv": df.select("record_id", "path", "line_no", "key", "value"),
        "units": df.select("record_id", "path", "text"),
        "urls": df.select("record_id", "path", F.col("url").alias("value")),
        "logs": df.select("record_id", F.split("text", " ").alias("fields"), F.lit(False).alias("body_sourced")),
    }


def rows(df):
    return sorted((r.rule_id, r.severity, r.record_id, r.subject or "") for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    data = spark.createDataFrame(
        [(str(i), "svc/a", i, "db.password" if i % 2 else "cvv", f"value{i}x", f"pan note {4111111111111111 if i % 3 == 0 else 7}", "http://a.b/c" if i % 4 else "https://x") for i in range(40)],
        ROWS,
    )
    source = str(tmp_path / "in")
    data.repartition(4).write.parquet(source)
    out, log = scratch_path(spark, "findings"), scratch_path(spark, "log")
    got = scan_available(spark, source, data.schema, inputs, out, log)
    local = tuple(r for r in DEFAULT_RULES if r.row_local)
    assert rows(got) == rows(run_scans(inputs(data), local)) != []

    # New files are appended; files already scanned are not read again.
    before = got.count()
    one = data.filter("record_id = '1'")
    one.write.mode("append").parquet(source)
    more = scan_available(spark, source, data.schema, inputs, out, log)
    assert more.count() == before + run_scans(inputs(one), local).count()


def test_group_rules_stay_out_of_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "p", 1, "card.x", "v", "t", "u")], ROWS).write.parquet(source)
    stream = spark.readStream.schema(ROWS).parquet(source)
    plan = scan_stream({"kv": stream.select("record_id", "path", "line_no", "key", "value")})
    assert plan.isStreaming
    assert "Aggregate" not in plan._jdf.queryExecution().analyzed().toString()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    cut = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert cut.count() == 5
    assert "Range" not in cut._jdf.queryExecution().analyzed().toString()
    assert all(shared_dir(spark) in f for f in cut.inputFiles())


TIMED = "event_time timestamp, record_id string, path string, text string"


def card(minute, record, number="4111111111111111"):
    return (datetime(2024, 1, 1, 0, 0) + timedelta(minutes=minute), record, "svc/a", f"pan {number}")


def cards(df):
    return {"units": df}


def deliver(spark, rows, source):
    spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(source)


def slots(found):
    return sorted((r.slot.hour * 60 + r.slot.minute if r.slot else None, r.record_id) for r in found.collect())


def test_findings_are_reported_once_a_slot(spark, tmp_path):
    """Repeats in a slot are one report; replays, late rows and restarts from the checkpoint change nothing."""
    source, out, log = str(tmp_path / "in"), scratch_path(spark, "findings"), scratch_path(spark, "log")

    def run():
        return slots(scan_available(spark, source, spark.createDataFrame([], TIMED).schema, cards, out, log, event_time="event_time", files_per_batch=1))

    deliver(spark, [card(1, "a"), card(9, "a"), card(3, "b"), card(11, "a")], source)
    assert run() == [(0, "a"), (0, "b"), (10, "a")]
    # The same again in a new call, from the checkpoint; and a row that is late, but not too late.
    deliver(spark, [card(1, "a"), card(12, "a"), card(5, "c"), card(4, "b")], source)
    assert run() == [(0, "a"), (0, "b"), (0, "c"), (10, "a")]
    # The watermark goes to 0:50; what comes from before it afterwards is dropped, replayed or not.
    deliver(spark, [card(60, "a")], source)
    assert run() == [(0, "a"), (0, "b"), (0, "c"), (10, "a"), (60, "a")]
    deliver(spark, [card(1, "a"), card(20, "new"), card(52, "late")], source)
    assert run() == [(0, "a"), (0, "b"), (0, "c"), (10, "a"), (50, "late"), (60, "a")]


def test_state_is_forgotten_and_rows_without_time_are_kept(spark, tmp_path):
    source, out, log = str(tmp_path / "in"), scratch_path(spark, "findings"), scratch_path(spark, "log")
    untimed = (None, "x", "svc/a", "pan 4111111111111111")
    deliver(spark, [card(m, f"r{m}") for m in range(0, 300, 20)] + [untimed, untimed], source)
    deliver(spark, [card(600, "last")], source)
    deliver(spark, [card(900, "end")], source)
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_findings(report_once(timed_findings(cards(stream), time="event_time")), out, log)
    query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 19 and found.filter("slot IS NULL").count() == 2
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 1
    with pytest.raises(ValueError):
        report_once(found.withColumnRenamed("slot", "event_time"), reuse_minutes=20, delay_minutes=10)


def test_all_row_rules_carry_event_time(spark):
    """Every row-local rule that reads units, kv, urls or logs finds the same with event time as without."""
    data = spark.createDataFrame(
        [(str(i), "svc/a", i, "db.password" if i % 2 else "cvv", f"value{i}x", f"pan note {4111111111111111 if i % 3 == 0 else 7}", "http://a.b/c") for i in range(20)], ROWS
    )
    plain = inputs(data)
    timed = {k: v.withColumn("event_time", F.lit("2024-01-01").cast("timestamp")) for k, v in plain.items()}
    local = tuple(r for r in DEFAULT_RULES if r.row_local and r.needs[0] in plain)
    got = timed_findings(timed, local)
    assert rows(got) == rows(run_scans(plain, local)) and got.filter("event_time IS NULL").isEmpty()
