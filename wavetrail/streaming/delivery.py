"""Delivery of alerts from stored logs: messages as a stream, attempts as a loop with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail.operators import outbox
from wavetrail.session import cut
from wavetrail.sources.sinks import alerts_of, reroute_messages, stored_log, write_attempts

ATTEMPT_FIELDS = "tenant_id string, alert_id string, attempt long, pass long, at timestamp, ok boolean, error string"

# gives the outcome (tenant_id, alert_id, ok, error) of signals to alerts; alerts it leaves out stay pending
Signal = Callable[[DataFrame], DataFrame]


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The observation log as a stream; only committed files are seen."""
    return spark.readStream.schema(schema).parquet(path)


def deliver_reroutes(log: DataFrame, path: str, checkpoint: str) -> None:
    """Write one reroute message per alert of the log, each exactly once, then stop."""
    messages = reroute_messages(alerts_of(log)).select("value")
    query = (
        messages.writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The attempt log at `path`; empty before the first attempt."""
    log = stored_log(spark, path)
    if log is None:
        return spark.createDataFrame([], ATTEMPT_FIELDS)
    return log.withColumn("tenant_id", F.col("tenant_id").cast("string"))


def dispatch_once(
    alerts: DataFrame, path: str, signal: Signal, tokens: DataFrame, now: Column, number: int,
    max_attempts: int = outbox.MAX_ATTEMPTS, k: int = outbox.PASS_LIMIT,
) -> None:
    """Pass `number` over append-only `alerts`: state from the attempt log, signals, outcomes back into it.

    A pass that is in the log is not made again. One that died before its outcomes were stored sends the
    same signals once more, under the same alert ids, by which a receiver knows them
    (`reroutes.accept_signals`); its outcomes are stored once, by (alert, attempt). At most `k` alerts a
    tenant are tried. State columns that `alerts` brings are not read.
    """
    log = read_attempts(alerts.sparkSession, path)
    if not log.filter(F.col("pass") == number).isEmpty():
        return
    state = outbox.outbox_state(alerts, log, max_attempts)
    chosen = cut(outbox.pending_top_k(outbox.dispatch_scope(state, tokens), now, k))
    tried = outbox.one_outcome(signal(chosen))
    attempts = chosen.select(*outbox.ALERT_KEY, (F.col("attempts") + 1).alias("attempt")).join(tried, list(outbox.ALERT_KEY))
    write_attempts(
        # signals are sent by this action; the write below reads what came back
        cut(attempts.select(
            *outbox.ALERT_KEY, "attempt", F.lit(number).cast("long").alias("pass"), now.alias("at"), "ok", "error")),
        path,
    )


def dispatch_stream(
    ticks: DataFrame, alerts: Callable[[], DataFrame], path: str, signal: Signal, tokens: DataFrame, checkpoint: str,
    max_attempts: int = outbox.MAX_ATTEMPTS, k: int = outbox.PASS_LIMIT,
) -> None:
    """One pass for each micro-batch of `ticks` (column `at`), at its latest time; ends when they are used up.

    The number of the micro-batch is the number of the pass, so one that is repeated after a failure
    changes nothing. `alerts` is asked at each pass and gives the alerts stored until then.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        latest = batch.agg(F.max("at").cast("string").alias("at")).first().at
        if latest is None:
            return
        now = F.lit(latest).cast(batch.schema["at"].dataType)
        dispatch_once(alerts(), path, signal, tokens, now, number, max_attempts, k)

    started = (
        ticks.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
