"""Congestion detector: gate, baselines, dedup, rolling mean, cooldown.

Time is the arrival clock of the rows (`received_at`), so a replay gives the
same answer. Arrival order is a total order given by a tuple of columns whose
first entry is the clock.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.identity import alert_id, valid_id
from wavetrail.operators.ordered import (
    SEED,
    HALO,
    first_at_or_after,
    first_per,
    follow_jumps,
    heavy_groups,
    over_history,
    split_by_weight,
)
from wavetrail.session import cut, small_side, written

CLOCK = "received_at"
ARRIVAL = (CLOCK, "export_id", "rs_pos", "ss_pos", "sp_pos")
RUN_KEY = ("tenant_id", "workflow_id", "run_id")
AISLE_KEY = ("tenant_id", "site_id", "aisle")
WINDOW_KEY = ("tenant_id", "site_id", "aisle", "workflow_id", "run_id")
EVENT_KEY = ("tenant_id", "event_id")

# Freshness limits and the longest accepted movement.
MAX_AGE = timedelta(minutes=5)
MAX_AHEAD = timedelta(minutes=1)
MAX_SECONDS = 3600.0
# start of the open session, on rows known from before
CARRIED = "_carried"


@dataclass(frozen=True)
class DetectorConfig:
    """Detector parameters; `heavy_rows`, `chunk_rows` and `fold_rows` only steer the plan."""

    window: int = 3
    sigma: float = 2.5
    cooldown: timedelta = timedelta(seconds=60)
    idle_ttl: timedelta = timedelta(minutes=10)
    arrival: Sequence[str] = field(default=ARRIVAL)
    heavy_rows: int = 5_000_000
    chunk_rows: int = 1_000_000
    fold_rows: int = 10_000

    def __post_init__(self) -> None:
        if not 2 <= self.window <= 100:
            raise ValueError("window must be 2..100")
        if not (self.sigma > 0 and math.isfinite(self.sigma)):
            raise ValueError("sigma must be positive and finite")
        if self.cooldown <= timedelta(0):
            raise ValueError("cooldown must be positive")
        if self.idle_ttl <= timedelta(0):
            raise ValueError("idle_ttl must be positive")
        if self.arrival[0] != CLOCK:
            raise ValueError(f"arrival order must begin with {CLOCK}")
        if min(self.heavy_rows, self.chunk_rows, self.fold_rows) < 1:
            raise ValueError("row limits must be positive")


def _interval(delta: timedelta) -> Column:
    return F.lit(delta)


# --- gate -----------------------------------------------------------------


def stale_or_future(observed_at: Column, now: Column) -> Column:
    """True outside [now - 5 min, now + 1 min]; a missing time counts as stale."""
    outside = (observed_at > now + _interval(MAX_AHEAD)) | (observed_at < now - _interval(MAX_AGE))
    return F.coalesce(outside, F.lit(True))


def gate_reason() -> Column:
    """Why an observation is refused on entry; null when it is acceptable."""
    seconds = F.col("seconds")
    ids = [valid_id(c) for c in ("tenant_id", "site_id", "aisle", "task_id")]
    present = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("event_id", "run_id")]
    all_ok = ids[0]
    for check in [*ids[1:], *present]:
        all_ok = all_ok & check
    bad_seconds = seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds > MAX_SECONDS)
    return (
        F.when(~all_ok, "invalid_id")
        .when(bad_seconds, "invalid_duration")
        .when(stale_or_future(F.col("observed_at"), F.col(CLOCK)), "stale_or_future")
    )


def gate_observations(observations: DataFrame) -> DataFrame:
    """Rows that pass every entry check."""
    return observations.filter(gate_reason().isNull())


def gate_rejects(observations: DataFrame) -> DataFrame:
    """Rows that fail an entry check, with `reject_reason`."""
    return observations.withColumn("reject_reason", gate_reason()).filter(
        F.col("reject_reason").isNotNull()
    )


# --- baselines ------------------------------------------------------------


def baseline_threshold(baselines: DataFrame, sigma: float) -> DataFrame:
    """Adds `threshold` = mean + sigma * stddev."""
    return baselines.withColumn("threshold", F.col("mean") + F.lit(float(sigma)) * F.col("stddev"))


def validate_baselines(baselines: DataFrame, sigma: float) -> DataFrame:
    """Violating rows: bad ids, non-positive or NaN values, infinite threshold."""
    bad_ids = ~(valid_id("tenant_id") & valid_id("site_id") & valid_id("aisle"))
    mean, stddev = F.col("mean"), F.col("stddev")
    bad_mean = mean.isNull() | F.isnan(mean) | (mean <= 0)
    bad_stddev = stddev.isNull() | F.isnan(stddev) | (stddev <= 0)
    infinite = F.abs(mean + F.lit(float(sigma)) * stddev) == F.lit(float("inf"))
    reason = (
        F.when(bad_ids, "invalid_id")
        .when(bad_mean, "invalid_mean")
        .when(bad_stddev, "invalid_stddev")
        .when(infinite, "infinite_threshold")
    )
    return baselines.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def duplicate_baselines(baselines: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    counts = baselines.groupBy(*AISLE_KEY).agg(F.count("*").alias("copies"))
    return counts.filter("copies > 1")


def require_baselines(baselines: DataFrame, sigma: float) -> DataFrame:
    """The same rows, or ValueError when the list is empty, repeated or invalid."""
    if baselines.isEmpty():
        raise ValueError("at least one baseline is required")
    if not duplicate_baselines(baselines).isEmpty():
        raise ValueError("duplicate baseline")
    shown = validate_baselines(baselines, sigma).limit(5).collect()
    if shown:
        raise ValueError(f"invalid baselines: {shown}")
    return baselines


def join_baselines(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Observations with `mean` and `stddev` of their (tenant, site, aisle)."""
    return observations.join(small_side(baselines), list(AISLE_KEY))


def missing_baseline(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Observations without a baseline."""
    keys = baselines.select(*AISLE_KEY)
    return observations.join(small_side(keys), list(AISLE_KEY), "left_anti")


def entry_reason(observations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Adds `entry_reason`: why the detector refuses a row (gate, no_baseline), null when it enters."""
    known = small_side(baselines.select(*AISLE_KEY).distinct().withColumn("_known", F.lit(True)))
    joined = observations.join(known, list(AISLE_KEY), "left")
    unknown = F.when(F.col("_known").isNull(), "no_baseline")
    return joined.withColumn("entry_reason", F.coalesce(gate_reason(), unknown)).drop("_known")


# --- dedup ----------------------------------------------------------------


def dedup_events(
    observations: DataFrame, arrival: Sequence[str], stored: DataFrame | None = None
) -> DataFrame:
    """First arrival per (tenant, event); events already in `stored` are dropped."""
    first = first_per(observations, EVENT_KEY, arrival)
    if stored is None:
        return first
    return first.join(stored.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")


# --- state of the windows -------------------------------------------------


def _last_rows(rows: DataFrame, config: DetectorConfig) -> DataFrame:
    """State from rows (window key, arrival, seconds, session_start, `_fired`)."""
    latest = Window.partitionBy(*WINDOW_KEY).orderBy(*[F.col(c).desc() for c in config.arrival])
    # a rank filter: Spark keeps the last rows of a key per task before they are shuffled
    tail = rows.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") < config.window)
    value = F.struct(*config.arrival, "seconds")
    tails = tail.groupBy(*WINDOW_KEY).agg(
        F.sort_array(F.collect_list(value)).alias("tail"),
        F.max("session_start").alias("session_start"),
    )
    fired = rows.groupBy(*WINDOW_KEY).agg(F.max("_fired").alias("last_alert"))
    current = F.when(F.col("last_alert") >= F.col("session_start"), F.col("last_alert"))
    return tails.join(fired, list(WINDOW_KEY)).withColumn("last_alert", current)


def window_state(log: DataFrame, config: DetectorConfig) -> DataFrame:
    """State after a log, one row per window key.

    `tail`: the last N - 1 rows (arrival, seconds); `session_start` of the open session;
    `last_alert`: when it fired last in that session, or null. `log` has committed rows with a
    nullable `alert` (with `fired_at`); where it has no `session_start`, sessions are told anew.
    """
    if "session_start" not in log.columns:
        log = rolling_mean(*_rolling_input(log, config))
    return _last_rows(
        log.select(
            *WINDOW_KEY, *config.arrival, "seconds", "session_start", F.col("alert.fired_at").alias("_fired")
        ),
        config,
    )


def _rolling_input(rows: DataFrame, config: DetectorConfig):
    light, heavy, n_heavy = split_by_weight(rows, RUN_KEY, config.heavy_rows)
    return light, config, heavy, n_heavy


def state_of_keys(state: DataFrame, observations: DataFrame) -> DataFrame:
    """The rows of a state whose window keys `observations` have."""
    keys = observations.select(*WINDOW_KEY).distinct()
    return state.join(small_side(keys), list(WINDOW_KEY), "left_semi")


def advance_state(state: DataFrame, log_slice: DataFrame, config: DetectorConfig) -> DataFrame:
    """`window_state` of a log and a slice after it, from the state of the log and the slice alone."""
    before = state.select(*WINDOW_KEY, F.explode("tail").alias("_row"), "session_start", "last_alert")
    columns = [*WINDOW_KEY, *config.arrival, "seconds", "session_start"]
    known = before.select(
        *WINDOW_KEY, "_row.*", "session_start", F.col("last_alert").alias("_fired")
    )
    fresh = log_slice.select(*columns, F.col("alert.fired_at").alias("_fired"))
    return _last_rows(known.unionByName(fresh), config)


def _seeds(state: DataFrame) -> DataFrame:
    """The tails of a state as rows that come before new ones."""
    rows = state.select(*WINDOW_KEY, F.explode("tail").alias("_row"), F.col("session_start").alias(CARRIED))
    return rows.select(*WINDOW_KEY, "_row.*", CARRIED, F.lit(True).alias(SEED))


def _seeded(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """`rows` and, before them, the seeds of a state."""
    if state is None:
        return rows
    return rows.withColumn(SEED, F.lit(False)).unionByName(_seeds(state), allowMissingColumns=True)


# --- rolling window -------------------------------------------------------


def _rolling(config: DetectorConfig):
    order = [F.col(c) for c in config.arrival]

    def compute(rows: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*order)
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        last_n = w.rowsBetween(-(config.window - 1), 0)
        previous = F.lag(CLOCK).over(w)
        opens = previous.isNull() | (F.col(CLOCK) - previous > _interval(config.idle_ttl))
        return (
            rows.withColumn("_opens", opens)
            .withColumn("_rn", F.row_number().over(w))
            .withColumn("_first", F.max(F.when(F.col("_opens"), F.col("_rn"))).over(running))
            .withColumn("session_start", opened(rows, running))
            .withColumn("mean_seconds", F.avg("seconds").over(last_n))
            .withColumn("is_full", F.col("_rn") - F.col("_first") + 1 >= config.window)
            .withColumn("mean_seconds", F.when(F.col("is_full"), F.col("mean_seconds")))
            .drop("_opens", "_rn", "_first", CARRIED)
        )

    def opened(rows: DataFrame, running) -> Column:
        start = F.max(F.when(F.col("_opens") & ~F.col(HALO), F.col(CLOCK))).over(running)
        return F.greatest(start, F.max(CARRIED).over(running)) if CARRIED in rows.columns else start

    return compute


def rolling_mean(
    committed: DataFrame, config: DetectorConfig, heavy: DataFrame | None = None, heavy_rows: int = 0
) -> DataFrame:
    """Adds `session_start`, `is_full` and `mean_seconds` (null until N values are present).

    A session opens with the first row of a window key and after a pause longer
    than `idle_ttl`. `heavy` holds the rows of runs too large for one task. Rows
    flagged `SEED` are the last ones of a log; they are not returned.
    """
    return over_history(
        committed,
        WINDOW_KEY,
        config.arrival,
        _rolling(config),
        lookback=config.window - 1,
        payload=[CLOCK, "seconds"],
        segment="session_start",
        heavy=heavy,
        heavy_rows=heavy_rows,
        chunk_rows=config.chunk_rows,
    )


def idle_sessions(committed: DataFrame, config: DetectorConfig) -> DataFrame:
    """One row per session: start, last arrival and number of rows."""
    return (
        rolling_mean(committed, config)
        .groupBy(*WINDOW_KEY, "session_start")
        .agg(F.max(CLOCK).alias("last_seen"), F.count("*").alias("n_rows"))
    )


def full_windows(rolled: DataFrame) -> DataFrame:
    """Rows whose session already holds N values."""
    return rolled.filter("is_full")


def breaches(rolled: DataFrame) -> DataFrame:
    """Full windows whose mean reaches the threshold (equality counts)."""
    return rolled.filter(F.col("is_full") & (F.col("mean_seconds") >= F.col("threshold")))


# --- cooldown -------------------------------------------------------------


def _bursts(config: DetectorConfig):
    order = [F.col(c) for c in config.arrival]

    def compute(rows: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*order)
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        previous = F.lag(F.struct(CLOCK, "session_start")).over(w)
        opens = (
            previous.isNull()
            | (F.col(CLOCK) - previous[CLOCK] >= _interval(config.cooldown))
            | (F.col("session_start") != previous["session_start"])
        )
        return (
            rows.withColumn("_opens", opens)
            .withColumn(
                "_burst", F.max(F.when(F.col("_opens") & ~F.col(HALO), F.col(CLOCK))).over(running)
            )
            .drop("_opens")
        )

    return compute


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _fold_bursts(bursts: DataFrame, config: DetectorConfig) -> DataFrame:
    """Greedy cooldown over short bursts, as a sorted fold inside the JVM."""
    names = [c for c in bursts.columns if c not in (*WINDOW_KEY, "_burst")]
    ordered = [*config.arrival, *[c for c in names if c not in config.arrival]]
    row = F.struct(*ordered, _micros(CLOCK).alias("_us"))
    grouped = bursts.groupBy(*WINDOW_KEY, "_burst").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    cooldown = int(config.cooldown / timedelta(microseconds=1))
    empty = F.slice("_rows", 1, 0)
    fired = F.aggregate(
        "_rows",
        F.struct(F.lit(None).cast("long").alias("last"), empty.alias("fired")),
        lambda acc, x: F.when(
            acc["last"].isNull() | (x["_us"] - acc["last"] >= cooldown),
            F.struct(x["_us"].alias("last"), F.concat(acc["fired"], F.array(x)).alias("fired")),
        ).otherwise(acc),
        lambda acc: acc["fired"],
    )
    return grouped.select(*WINDOW_KEY, F.explode(fired).alias("_row")).select(
        *WINDOW_KEY, *[F.col(f"_row.{c}").alias(c) for c in names]
    )


def _jump_bursts(bursts: DataFrame, config: DetectorConfig) -> DataFrame:
    """Greedy cooldown over bursts too long for one task, by pointer doubling."""
    cooldown = int(config.cooldown / timedelta(microseconds=1))
    keys = [*WINDOW_KEY, "_burst"]
    tagged = cut(bursts.withColumn("_us", _micros(CLOCK)))
    nodes = cut(tagged.select(*keys, "_us").distinct())
    probes = nodes.withColumn("_probe", F.col("_us") + cooldown)
    # inside a burst gaps are below the cooldown; narrower bins keep each one small
    hits = first_at_or_after(nodes, probes, keys, "_us", max(cooldown // 64, 1))
    jumps = hits.select(*keys, "_us", F.col("_hit").alias("nxt"))
    start = nodes.groupBy(*keys).agg(F.min("_us").alias("_us"))
    fired = follow_jumps(start, jumps, keys, "_us")
    hit_rows = tagged.join(fired, [*keys, "_us"], "left_semi")
    # rows of one instant: the first in arrival order fires
    return first_per(hit_rows, [*WINDOW_KEY, "_us"], config.arrival).select(
        *[c for c in bursts.columns if c != "_burst"]
    )


def suppress_cooldown(
    breached: DataFrame, config: DetectorConfig, state: DataFrame | None = None
) -> DataFrame:
    """Breaches that fire: none fired within `cooldown` before them in the session.

    A breach at least one cooldown after the breach before it always fires, so
    breaches split into bursts that are folded on their own. Suppressed breaches
    do not restart the clock. The last alert of a key's `state` stands before its
    breaches as one that has fired already.
    """
    if state is not None:
        known = state.filter(F.col("last_alert").isNotNull()).select(
            *WINDOW_KEY, F.col("last_alert").alias(CLOCK), "session_start", F.lit(True).alias(SEED)
        )
        both = breached.withColumn(SEED, F.lit(False)).unionByName(known, allowMissingColumns=True)
        plain = both.withColumnRenamed(SEED, "_known")
        return suppress_cooldown(plain, config).filter(~F.col("_known")).drop("_known")
    columns = breached.columns
    rows = written(breached, "breaches")
    few = min(config.fold_rows, config.heavy_rows)
    is_small = rows.limit(few + 1).count() <= few
    light, heavy, n_heavy = (
        (rows, None, 0) if is_small else split_by_weight(rows, WINDOW_KEY, config.heavy_rows)
    )
    bursts = over_history(
        light,
        WINDOW_KEY,
        config.arrival,
        _bursts(config),
        lookback=1,
        payload=[CLOCK, "session_start"],
        segment="_burst",
        heavy=heavy,
        heavy_rows=n_heavy,
        chunk_rows=config.chunk_rows,
    )
    if is_small:
        return _fold_bursts(bursts, config).select(*columns)
    keys = [*WINDOW_KEY, "_burst"]
    bursts = written(bursts, "bursts")
    long_bursts = cut(heavy_groups(bursts, keys, config.fold_rows).select(*keys))
    if long_bursts.isEmpty():
        return _fold_bursts(bursts, config).select(*columns)
    listed = small_side(long_bursts)
    short = _fold_bursts(bursts.join(listed, keys, "left_anti"), config)
    long = _jump_bursts(bursts.join(listed, keys, "left_semi"), config)
    return short.select(*columns).unionByName(long.select(*columns))


# --- the whole chain ------------------------------------------------------


def committed_windows(
    observations: DataFrame,
    baselines: DataFrame,
    config: DetectorConfig,
    stored: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Gate, baseline join, dedup on (tenant, event) and rolling mean.

    The dedup key does not contain the run, so dedup and windows have an exchange each: an
    event may be sent for two runs, and only its first arrival counts, whatever the run's size.
    Events in `stored` are committed already; windows go on from `state`, which comes from rows that
    arrived before. Runs are weighed by their valid rows.
    """
    joined = join_baselines(gate_observations(observations), baselines)
    valid = baseline_threshold(joined, config.sigma)
    first = _seeded(dedup_events(valid, config.arrival, stored), state)
    light, heavy, n_heavy = split_by_weight(
        first, RUN_KEY, config.heavy_rows, counted=gate_observations(observations).select(*RUN_KEY)
    )
    return rolling_mean(light, config, heavy, n_heavy)


def detect_congestion(
    observations: DataFrame,
    baselines: DataFrame,
    config: DetectorConfig,
    stored: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Alerts: one row per breach that fires.

    `stored` is the log of what was committed before (see `observation_log`): its events count no
    more, and windows, sessions and cooldowns go on where it ends. `state`, kept by
    `advance_state`, spares reading it from the log. Slices must come in arrival order.
    """
    if state is None and stored is not None:
        state = window_state(stored, config)
    if state is not None:
        state = cut(state_of_keys(state, observations))
    rolled = committed_windows(observations, baselines, config, stored, state)
    return alerts_of_windows(rolled, config, state)


def alerts_of_windows(
    rolled: DataFrame, config: DetectorConfig, state: DataFrame | None = None
) -> DataFrame:
    """The alerts that committed windows fire after the alerts of `state`."""
    needed = dict.fromkeys(
        [*WINDOW_KEY, "event_id", *config.arrival, "session_start", "mean_seconds", "threshold"]
    )
    fired = suppress_cooldown(breaches(rolled).select(*needed), config, state)
    return fired.select(
        alert_id("tenant_id", "event_id").alias("alert_id"),
        *WINDOW_KEY,
        "event_id",
        "mean_seconds",
        F.col("threshold").alias("threshold_seconds"),
        F.col(CLOCK).alias("fired_at"),
    )


SALTS = 64


def ranked_entries(
    observations: DataFrame, baselines: DataFrame, config: DetectorConfig
) -> DataFrame:
    """Every input row with `threshold`, `entry_reason` and `_first`: the first arrival of its event.

    Rows that do not enter are dealt out by a hash. Arrivals of one event are ranked in `SALTS`
    parts first and then their winners, so a hot event never meets in one task.
    """
    known = baseline_threshold(baselines, config.sigma).dropDuplicates(list(AISLE_KEY))
    known = known.select(*AISLE_KEY, "threshold", F.lit(True).alias("_known"))
    joined = observations.join(small_side(known), list(AISLE_KEY), "left")
    unknown = F.when(F.col("_known").isNull(), "no_baseline")
    rows = joined.withColumn("entry_reason", F.coalesce(gate_reason(), unknown)).drop("_known")
    enters = F.col("entry_reason").isNull()
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*config.arrival), F.lit(SALTS)) + 1)
    order = [F.col(c) for c in config.arrival]
    in_part = Window.partitionBy(*EVENT_KEY, "_salt", enters).orderBy(*order)
    rows = rows.withColumn("_rank", F.when(enters, F.row_number().over(in_part)))
    winner = F.coalesce(F.col("_rank") == 1, F.lit(False))
    rows = rows.withColumn("_salt", F.when(winner, 0).otherwise(F.col("_salt")))
    among = Window.partitionBy(*EVENT_KEY, "_salt").orderBy(*order)
    return rows.withColumn("_first", winner & (F.row_number().over(among) == 1)).drop("_rank", "_salt")


def observation_outcome(
    observations: DataFrame, baselines: DataFrame, config: DetectorConfig
) -> DataFrame:
    """Every input row with `outcome`: a reject reason, no_baseline, duplicate, committed or alert.

    The input is read once: rows are gated, joined and ranked with a flag, and written. What the
    windows need comes from there, and only alerts, one per event, are joined back to the first
    arrivals; all other rows have their outcome already.
    """
    ranked = cut(ranked_entries(observations, baselines, config))
    first = ranked.filter("_first")
    needed = dict.fromkeys([*WINDOW_KEY, "event_id", *config.arrival, "seconds", "threshold"])
    alerts = alerts_of_windows(rolling_mean(*_rolling_input(first.select(*needed), config)), config)
    fired = alerts.select(*EVENT_KEY, F.lit(True).alias("_fired"))
    columns = observations.columns
    rest = ranked.filter(~F.col("_first")).select(
        *columns, F.coalesce("entry_reason", F.lit("duplicate")).alias("outcome")
    )
    told = first.join(fired, list(EVENT_KEY), "left").select(
        *columns, F.when(F.col("_fired"), "alert").otherwise("committed").alias("outcome")
    )
    return rest.unionByName(told)
