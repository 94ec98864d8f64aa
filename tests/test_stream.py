"""The stream in slices against the row-at-a-time loop."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tests.reference_detector import outcomes

from wavetrail import schemas
from wavetrail.operators import detector as d
from wavetrail.sources import sinks
from wavetrail.streaming import detector as stream

T0 = datetime(2024, 3, 1, 8)
SCHEMA = (
    "tenant_id string, site_id string, aisle string, workflow_id string, run_id string, task_id string,"
    "event_id string, seconds double, observed_at timestamp, received_at timestamp, seq int"
)
CONFIG = d.DetectorConfig(arrival=("received_at", "seq"), idle_ttl=timedelta(minutes=2))


def movements(n, seed):
    """One run holds most rows; events come again, some under another run."""
    rnd, rows, now = random.Random(seed), [], T0
    for i in range(n):
        now += timedelta(seconds=rnd.choice([0, 1, 5, 20, 200]))
        event = f"e{rnd.randrange(i + 1)}" if rnd.random() < 0.3 else f"e{i}"
        run = "hot" if rnd.random() < 0.7 else f"r{rnd.randrange(3)}"
        rows.append(("t1", "s1", f"A{rnd.randrange(3)}", "w", run, "pick", event, float(rnd.randrange(5, 30)), now, now, i))
    return rows


def run(spark, folder, parts, **options):
    source, log, state = (str(folder / n) for n in ("in", "log", "state"))
    baselines = spark.createDataFrame([("t1", "s1", f"A{i}", 10.0, 1.0) for i in range(3)], schemas.BASELINE)
    stream.use_state_store(spark)
    for part in parts:
        rows = spark.createDataFrame(part[::-1], SCHEMA)  # within a slice the order of rows means nothing
        rows.coalesce(1).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(rows.schema).parquet(source)
        stream.run_to_log(stream.detect_congestion_stream(arrivals, baselines, CONFIG, **options), log, state)
    return spark.read.parquet(log), state


def test_slices_answer_as_the_loop(spark, tmp_path):
    rows = movements(120, 5)
    log, _ = run(spark, tmp_path, [rows[:50], rows[50:]], lateness=timedelta(0))
    names = [f.split()[0] for f in SCHEMA.split(",")]
    expected = outcomes([dict(zip(names, r)) for r in rows], {("t1", "s1", f"A{i}"): (10.0, 1.0) for i in range(3)}, CONFIG)
    assert {"duplicate", "alert", "committed"} == set(expected)
    committed = sorted((r[6], r[4], o == "alert") for r, o in zip(rows, expected) if o != "duplicate")
    got = log.select("event_id", "run_id", F.col("alert").isNotNull().alias("fired")).collect()
    assert sorted(tuple(r) for r in got) == committed


def test_idle_windows_leave_no_state_and_late_rows_stay(spark, tmp_path):
    def row(i, aisle, minutes):
        at = T0 + timedelta(minutes=minutes)
        return ("t1", "s1", aisle, "w", "r", "pick", f"e{i}", 9.0, at, at, i)

    parts = [[row(0, "A0", 0), row(1, "A1", 0)], [row(2, "A2", 60)], [row(3, "A1", 1)]]
    log, state = run(spark, tmp_path, parts, lateness=timedelta(0))
    assert log.count() == 4  # the row of minute 1 is behind the watermark and is committed all the same
    windows = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "window").load(state)
    assert [r.key.aisle for r in windows.collect()] == ["A2"]


def test_alerts_of_the_stream_are_those_of_the_batch(spark, tmp_path):
    rows = movements(100, 11)
    log, _ = run(spark, tmp_path, [rows])
    baselines = spark.createDataFrame([("t1", "s1", f"A{i}", 10.0, 1.0) for i in range(3)], schemas.BASELINE)
    batch = d.detect_congestion(spark.createDataFrame(rows, SCHEMA), baselines, CONFIG)
    fields = ["alert_id", "run_id", "mean_seconds"]
    assert sorted(map(tuple, sinks.alerts_of(log).select(fields).collect())) == sorted(map(tuple, batch.select(fields).collect()))


def test_events_are_told_apart_without_python_state(spark, tmp_path):
    """Copies in one slice, in several files and under several runs: the first to arrive passes, nulls first."""
    def row(event, run, seq, minutes):
        at = T0 + timedelta(minutes=minutes)
        return ("t1", "s1", "A0", "w", run, "pick", event, 9.0, at, at, seq)

    first = [row("e0", "late", 5, 1), row("e0", "r", 2, 0), row("e0", "none", None, 0), row("e1", "r", 1, 0)]
    rows = first * 20 + [row(f"x{i}", "r", i, 2) for i in range(200)]
    log, state = run(spark, tmp_path, [rows, [row("e1", "again", 0, 0), row("e2", "r", 9, 3)]])
    got = log.select("event_id", "run_id").collect()
    assert len(got) == 203 and {tuple(r) for r in got if r.event_id[0] == "e"} == {("e0", "none"), ("e1", "r"), ("e2", "r")}
    names = {r.operatorName for r in spark.read.format("state-metadata").load(state).select("operatorName").collect()}
    assert "dedupe" in names
