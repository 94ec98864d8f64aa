"""Exports to alert to reroute: nine tasks, every export sent twice, one alert."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wavetrail import schemas
from wavetrail.operators import detector, ingest, outbox
from wavetrail.operators import reroutes as rr
from wavetrail.sources import sinks
from wavetrail.streaming import delivery
from wavetrail.streaming import detector as stream

T0 = datetime(2024, 3, 1, 8)
TOKEN = "token-of-demo-0001"
WORKFLOW, RUN_ID = "picking/demo/w1", "run-1"
SECONDS = [9, 10, 11, 30, 10, 10, 10, 10, 10]
TASKS = [(f"pick_{i:02}", "A01", "A02") for i in range(1, 9)] + [("pack_fast", "EXPRESS", "")]


def exports(spark, aisles):
    rows = []
    for i, (task, _, _) in enumerate(TASKS):
        end = T0 + timedelta(seconds=10 * i)
        nanos = int(end.replace(tzinfo=timezone.utc).timestamp()) * 10**9
        values = {
            "tenant.id": "demo", "warehouse.site": "hall-1", "warehouse.aisle": aisles[i],
            "warehouse.task": task, "warehouse.wave": "w1", "temporal.workflow_id": WORKFLOW,
            "temporal.run_id": RUN_ID,
        }
        attributes = [(k, (v, None, None, None, None)) for k, v in values.items()]
        for copy in range(2):
            span = (
                "warehouse.movement", b"1234567890123456", f"span-{i:02}{copy}".encode(),
                Decimal(nanos - SECONDS[i] * 10**9), Decimal(nanos), None, attributes,
            )
            received = end + timedelta(seconds=1 + copy)
            rows.append((f"x{i}-{copy}", [TOKEN], received, [([([span],)],)]))
    return spark.createDataFrame(rows, schemas.EXPORT)


def inputs(spark):
    tokens = spark.createDataFrame([(TOKEN, "demo")], "token string, tenant_id string")
    baselines = spark.createDataFrame(
        [("demo", "hall-1", a, 10.0, 2.0) for a in ("A01", "A02", "EXPRESS")], schemas.BASELINE
    )
    return tokens, baselines


AISLES = ["A01"] * 4 + ["A02"] * 4 + ["EXPRESS"]


def test_closed_loop(spark):
    tokens, baselines = inputs(spark)
    observations = ingest.ingest(exports(spark, AISLES), tokens)
    assert observations.count() == 18
    outcome = detector.observation_outcome(observations, baselines, detector.DetectorConfig())
    counts = {r.outcome: r["count"] for r in outcome.groupBy("outcome").count().collect()}
    assert counts == {"committed": 8, "alert": 1, "duplicate": 9}
    fired = detector.detect_congestion(observations, baselines, detector.DetectorConfig())
    alert = fired.first()
    assert (alert.mean_seconds, alert.threshold_seconds, alert.aisle) == (17.0, 15.0, "A01")

    stored = fired.select(
        "tenant_id", "alert_id", "site_id", "workflow_id", "run_id", "aisle",
        F.col("fired_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("delivered_at"), F.lit("").alias("last_error"),
        F.lit(0).cast("long").alias("attempts"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(False).alias("dead"),
    )
    due = outbox.pending_top_k(outbox.dispatch_scope(stored, tokens), F.lit(T0 + timedelta(hours=1)))
    message = sinks.reroute_messages(due).select(
        F.from_json("value", ", ".join(f"{c} string" for c in sinks.REROUTE_FIELDS)).alias("m")
    )
    signals = message.select("m.*").withColumn("received_at", F.lit(alert.fired_at))
    steps = spark.createDataFrame(
        [("demo", "hall-1", WORKFLOW, RUN_ID, i + 1, t, a, alt, T0 + timedelta(seconds=10 * i - 5))
         for i, (t, a, alt) in enumerate(TASKS)],
        "tenant_id string, site_id string, workflow_id string, run_id string, hop int, step_id string,"
        "aisle string, alternative string, started_at timestamp",
    )
    result = rr.run_results(steps, rr.accept_signals(steps, signals), F.lit(T0 + timedelta(days=1))).first()
    assert result.aisles == AISLES
    assert (len(result.completed), result.n_accepted) == (9, 1)


def test_stream_gives_the_same_log_across_restarts(spark, tmp_path):
    tokens, baselines = inputs(spark)
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    stream.use_state_store(spark)
    landed = exports(spark, AISLES)
    at = F.col("received_at")
    cut_at = F.lit(T0 + timedelta(seconds=25))
    for part in (at < cut_at, at >= cut_at):
        landed.filter(part).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(schemas.EXPORT).parquet(source)
        observations = ingest.ingest(arrivals, tokens)
        out = stream.detect_congestion_stream(observations, baselines, detector.DetectorConfig())
        stream.run_to_log(out, log, state)
    rows = spark.read.parquet(log)
    assert rows.count() == 9 and rows.select("event_id").distinct().count() == 9
    alerts = sinks.alerts_of(rows).collect()
    batch = detector.detect_congestion(
        ingest.ingest(landed, tokens), baselines, detector.DetectorConfig()
    ).collect()
    assert [(a.alert_id, a.mean_seconds) for a in alerts] == [(b.alert_id, b.mean_seconds) for b in batch]

    for _ in range(2):  # a second run finds nothing new
        log_stream = delivery.read_log_stream(spark, log, rows.schema)
        delivery.deliver_reroutes(log_stream, str(tmp_path / "out"), str(tmp_path / "out-state"))
    sent = spark.read.json(str(tmp_path / "out")).collect()
    assert [(m.alert_id, m.aisle, m.run_id) for m in sent] == [(batch[0].alert_id, "A01", RUN_ID)]


def test_failed_commit_leaves_the_windows_untouched(spark, tmp_path):
    """A batch whose write fails is processed again from the same state."""
    tokens, baselines = inputs(spark)
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    stream.use_state_store(spark)
    exports(spark, AISLES).coalesce(1).write.parquet(source)
    calls = []

    def write(batch, number):
        calls.append(number)
        if len(calls) == 1:
            batch.count()  # the detector has run, the commit is lost
            raise OSError("log unavailable")
        batch.write.mode("append").parquet(log)

    def run():
        observations = ingest.ingest(
            spark.readStream.schema(schemas.EXPORT).parquet(source), tokens
        )
        out = stream.detect_congestion_stream(observations, baselines, detector.DetectorConfig())
        query = (
            out.writeStream.foreachBatch(write)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    # a later micro-batch without rows only moves the clock of the timers
    assert calls[:2] == [0, 0] and 0 not in calls[2:]
    rows = spark.read.parquet(log)
    assert rows.count() == 9
    assert [a.mean_seconds for a in sinks.alerts_of(rows).collect()] == [17.0]
