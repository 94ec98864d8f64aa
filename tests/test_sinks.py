import pytest
from pyspark.sql import functions as F

from wavetrail.operators import outbox
from wavetrail.sources import sinks

ALERT = "struct<alert_id:string,tenant_id:string,site_id:string,aisle:string,workflow_id:string,run_id:string,mean_seconds:double,threshold_seconds:double,fired_at:timestamp>"


def log(spark, rows):
    return spark.createDataFrame(rows, f"tenant_id string, event_id string, alert {ALERT}")


def test_a_repeated_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = log(spark, [("t1", f"e{i}", None) for i in range(4)])
    for part in (rows.filter("event_id < 'e2'"), rows, rows):
        sinks.write_observation_log(part, path)
    stored = spark.read.parquet(path)
    assert sorted(r.event_id for r in stored.collect()) == ["e0", "e1", "e2", "e3"]


def test_rows_of_no_or_of_two_tenants_are_refused(spark, tmp_path):
    alert = ("a", "t2", "s", "A", "w", "r", 1.0, 1.0, None)
    with pytest.raises(PermissionError):
        sinks.write_observation_log(log(spark, [("t1", "e", alert)]), str(tmp_path / "a"))
    with pytest.raises(PermissionError):
        sinks.write_observation_log(log(spark, [(None, "e", None)]), str(tmp_path / "b"))


def test_the_first_receipt_of_a_task_stays(spark, tmp_path):
    path = str(tmp_path / "receipts")
    schema = "tenant_id string, workflow_id string, run_id string, task_id string, aisle string, seq int"
    rows = spark.createDataFrame([("t", "w", "r", "one", "A2", 2), ("t", "w", "r", "one", "A1", 1), ("t", "w", "r", "two", "A3", 3)], schema)
    for part in (rows, rows.withColumn("aisle", F.lit("late"))):
        sinks.write_receipts(part, path, ["seq"])
    assert sorted((r.task_id, r.aisle) for r in spark.read.parquet(path).collect()) == [("one", "A1"), ("two", "A3")]


def test_repeated_outcomes_keep_one_alert(spark):
    alerts = spark.createDataFrame(
        [("t", "a", None, None, "", 0, None, False), ("t", "b", None, None, "", 0, None, False)],
        "tenant_id string, alert_id string, created_at timestamp, delivered_at timestamp, last_error string, attempts long, next_attempt_at timestamp, dead boolean")
    outcomes = spark.createDataFrame(
        [("t", "a", False, "down"), ("t", "a", True, None), ("t", "b", False, "late"), ("t", "b", False, "down")],
        "tenant_id string, alert_id string, ok boolean, error string")
    tokens = spark.createDataFrame([("secret-token-0001", "t")], "token string, tenant_id string")
    now = F.expr("timestamp '2024-01-01 00:00:00'")
    done = {r.alert_id: r for r in outbox.dispatch_pass(alerts, outcomes, tokens, now).collect()}
    assert len(done) == 2 and done["a"].delivered_at is not None and done["a"].attempts == 0
    assert (done["b"].last_error, done["b"].attempts) == ("down", 1)


def test_an_error_is_cut_between_characters(spark):
    texts = ["x" * 1999 + "é", "x" * 1998 + "é", "x" * 1997 + "\ufffd" + "y", "x" * 1996 + "\ufffd\ufffd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(outbox.truncate_error(F.col("t")).alias("t"))
    assert [r.t for r in rows.collect()] == ["x" * 1999, texts[1], texts[2][:-1], "x" * 1996 + "\ufffd"]


def test_a_stream_reaches_both_sinks_once(spark, tmp_path):
    source, archive, log, state = (str(tmp_path / n) for n in ("in", "archive", "log", "state"))
    schema = f"tenant_id string, event_id string, alert {ALERT}"
    for slice_ in (["e0", "e1"], ["e1", "e2"]):  # an event comes again in the second run
        log_rows = spark.createDataFrame([("t", e, None) for e in slice_], schema)
        log_rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sinks.fan_out_stream(stream, archive, lambda rows: sinks.write_observation_log(rows, log), state)
    assert spark.read.parquet(archive).count() == 4
    assert sorted(r.event_id for r in spark.read.parquet(log).collect()) == ["e0", "e1", "e2"]


def test_slices_are_appended_without_another_copy_of_the_log(spark, tmp_path, monkeypatch):
    from tests.test_stream import CONFIG, SCHEMA, movements

    from wavetrail import schemas
    from wavetrail.operators import detector as d
    from wavetrail.sources import incremental

    def refused(_):
        raise AssertionError("the joined log is materialised")

    monkeypatch.setattr(sinks, "cut", refused)
    baselines = spark.createDataFrame([("t1", "s1", f"A{i}", 10.0, 1.0) for i in range(3)], schemas.BASELINE)
    rows, path = movements(90, 7), str(tmp_path / "log")
    for part in (rows[:40], rows[40:], rows[40:]):
        incremental.run_slice(spark.createDataFrame(part, SCHEMA), baselines, CONFIG, path)
    log = spark.read.parquet(path)
    assert log.count() == len({r[6] for r in rows})
    whole = d.detect_congestion(spark.createDataFrame(rows, SCHEMA), baselines, CONFIG)
    assert sorted(r.alert_id for r in sinks.alerts_of(log).collect()) == sorted(r.alert_id for r in whole.collect()) != []
