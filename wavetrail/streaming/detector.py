"""The detector as a stream of two stateful stages.

The first stage is keyed by (tenant, event) and lets the first copy of an event pass, whatever
its run; it is Spark's own deduplication, without Python state. The second is keyed by the window, (tenant, site, aisle, workflow, run), and keeps its
last values, last alert and last arrival, so a hot run is spread over its windows. Rows of a
micro-batch are taken in arrival order, so the answer equals that of the batch operator as long
as micro-batches arrive in order; `read_span_stream` bounds a micro-batch in files or bytes.

The watermark of the stream follows the arrival clock by `lateness`. It drops no row: it only says
when a window has been idle for so long that its next row would begin a new session anyway, and the
state of such windows is removed. Each event leaves its key in the first stage, for good.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavetrail.functions.identity import alert_id
from wavetrail.operators import detector as d

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = timedelta(minutes=10)

WINDOW = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("last_alert", T.LongType()),
        T.StructField("last_seen", T.LongType()),
    ]
)
FIELDS = (
    "tenant_id", "workflow_id", "run_id", "site_id", "aisle", "task_id", "event_id", "seconds",
    "observed_at", "received_at",
)
OUTPUT = T.StructType(
    [T.StructField(c, T.StringType()) for c in FIELDS[:7]]
    + [
        T.StructField("seconds", T.DoubleType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("mean_seconds", T.DoubleType()),
        T.StructField("threshold_seconds", T.DoubleType()),
        T.StructField("fired", T.BooleanType()),
    ]
)


def _arrival(n: int):
    """Sort key of rows in arrival order (columns `_o0`, `_o1`, ...); nulls first, as in Spark."""
    names = [f"_o{i}" for i in range(n)]
    return lambda row: [(row[c] is not None, row[c]) for c in names]


def _first_rows(batches: Iterator, key: tuple[str, ...], order: list[str]) -> Iterator:
    """Of a task's rows of a micro-batch the first of each key in arrival order; nulls first, as in Spark."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    del held
    by = pc.sort_indices(rows.select(order), sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    keys = rows.select(list(key)).take(by).append_column("_at", by)
    # the first of each group, in one thread, which keeps the order of the rows
    first = keys.group_by(list(key), use_threads=False).aggregate([("_at", "first")])["_at_first"]
    yield from rows.take(first).to_batches(max_chunksize=10_000)


def first_copies(rows: DataFrame, n_arrival: int) -> DataFrame:
    """Rows of a stream whose event no earlier micro-batch had: of its copies in this one, the first to arrive.

    A micro-batch is freed of copies in columns first, so that of the rows of a key at most one comes to
    the deduplication of Spark, which keeps the keys in its own state and asks Python for nothing.
    """
    order = [f"_o{i}" for i in range(n_arrival)]
    single = rows.repartition(*d.EVENT_KEY).mapInArrow(
        lambda batches: _first_rows(batches, d.EVENT_KEY, order), rows.schema
    )
    return single.dropDuplicates(list(d.EVENT_KEY))


class WindowDetector(StatefulProcessor):
    """Rolling mean, session and cooldown of one window key."""

    def __init__(self, config: d.DetectorConfig):
        micros = timedelta(microseconds=1)
        self.arrival = _arrival(len(config.arrival))
        self.window = config.window
        self.cooldown = config.cooldown // micros
        self.idle_ttl = config.idle_ttl // micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", WINDOW)

    def _wake(self, last_seen: int) -> None:
        self.handle.registerTimer((last_seen + self.idle_ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.state.exists()
        values, last_alert, last_seen = self.state.get() if known else ([], None, None)
        for row in sorted(rows, key=self.arrival):
            now = row["_now"]
            if last_seen is not None and now - last_seen > self.idle_ttl:
                values, last_alert = [], None
            values = [*values, row["seconds"]][-self.window :]
            mean, fired = None, False
            if len(values) == self.window:
                total = 0.0
                for value in values:  # plain left-to-right sum, as in the batch window
                    total += value
                mean = total / self.window
                rearmed = last_alert is None or now - last_alert >= self.cooldown
                fired = rearmed and mean >= row["threshold"]
            last_alert, last_seen = (now if fired else last_alert), now
            yield Row(
                **{c: row[c] for c in FIELDS},
                mean_seconds=mean,
                threshold_seconds=row["threshold"],
                fired=fired,
            )
        self.state.update((values, last_alert, last_seen))
        if not known:
            self._wake(last_seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """One timer per window: it removes an idle window and is set again for one with new rows."""
        last_seen = self.state.get()[2]
        if timerValues.getCurrentWatermarkInMs() * 1000 > last_seen + self.idle_ttl:
            self.state.clear()
        else:
            self._wake(last_seen)
        return iter([])

    def close(self) -> None:
        pass


def detect_congestion_stream(
    observations: DataFrame,
    baselines: DataFrame,
    config: d.DetectorConfig,
    lateness: timedelta = LATENESS,
) -> DataFrame:
    """Streaming observation log: committed rows with a nullable `alert` struct.

    A window is removed once the arrival clock, less `lateness`, is past its idle time. The session
    needs the RocksDB state provider, see `use_state_store`.
    """
    valid = d.baseline_threshold(
        d.join_baselines(d.gate_observations(observations), baselines), config.sigma
    )
    clock = F.col(d.CLOCK).cast("timestamp")
    # the column of the watermark goes no further than this, so that no stage takes a row for late
    delay = f"{lateness // timedelta(milliseconds=1)} milliseconds"
    keyed = valid.withColumn("_mark", clock).withWatermark("_mark", delay).select(
        *[c for c in FIELDS if c not in ("observed_at", d.CLOCK)],
        F.col("observed_at").cast("timestamp").alias("observed_at"),
        clock.alias(d.CLOCK),
        "threshold",
        F.unix_micros(clock).alias("_now"),
        F.unix_micros(clock).alias("_o0"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(config.arrival[1:], 1)],
    )
    firsts = first_copies(keyed, len(config.arrival))
    committed = firsts.groupBy(*d.WINDOW_KEY).transformWithState(
        statefulProcessor=WindowDetector(config),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    alert = F.struct(
        alert_id("tenant_id", "event_id").alias("alert_id"),
        "tenant_id", "site_id", "aisle", "workflow_id", "run_id", "mean_seconds",
        "threshold_seconds", F.col("received_at").alias("fired_at"),
    )
    return committed.withColumn("alert", F.when(F.col("fired"), alert)).drop(
        "mean_seconds", "threshold_seconds", "fired"
    )


def use_state_store(spark: SparkSession) -> None:
    """Select the RocksDB state store, which map state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def run_to_log(log: DataFrame, path: str, checkpoint: str) -> None:
    """Process all available input into the Parquet log (exactly once), then stop."""
    query = (
        log.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
