"""Queries of the detector over movements derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import detector as d
from wavetrail.plans.movements import (
    CONFIG,
    DETECTOR_SQL,
    baselines,
    completed_movements,
    with_,
)
from wavetrail.plans.registry import query
from wavetrail.session import new_table_path
from wavetrail.sources.incremental import run_slice

KEYS = "tenant_id, site_id, aisle, workflow_id, run_id"
ROW = "seq, redelivery"


def _sql(select: str) -> str:
    return with_(DETECTOR_SQL, select, recursive=True)


def _rolled(spark, sf_dir):
    rows = d.committed_windows(completed_movements(spark, sf_dir), baselines(spark), CONFIG)
    return rows.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(
    "gate_observations",
    _sql("select seq, redelivery, event_id, seconds from gated where reject_reason is null"),
)
def gate_observations(spark, sf_dir):
    rows = d.gate_observations(completed_movements(spark, sf_dir))
    return rows.select("seq", "redelivery", "event_id", "seconds")


@query(
    "gate_rejects",
    _sql("select seq, redelivery, reject_reason from gated where reject_reason is not null"),
)
def gate_rejects(spark, sf_dir):
    rows = d.gate_rejects(completed_movements(spark, sf_dir))
    return rows.select("seq", "redelivery", "reject_reason")


@query(
    "join_baselines",
    _sql(
        "select seq, redelivery, mean, stddev, threshold from valid"
    ),
)
def join_baselines(spark, sf_dir):
    rows = d.gate_observations(completed_movements(spark, sf_dir))
    joined = d.baseline_threshold(d.join_baselines(rows, baselines(spark)), CONFIG.sigma)
    return joined.select("seq", "redelivery", "mean", "stddev", "threshold")


@query(
    "missing_baseline",
    _sql(
        """select seq, redelivery, tenant_id, site_id, aisle from gated
           where reject_reason is null
             and (tenant_id, site_id, aisle) not in (select tenant_id, site_id, aisle from baselines)"""
    ),
)
def missing_baseline(spark, sf_dir):
    rows = d.gate_observations(completed_movements(spark, sf_dir))
    missing = d.missing_baseline(rows, baselines(spark))
    return missing.select("seq", "redelivery", "tenant_id", "site_id", "aisle")


@query("dedup_events", _sql("select event_id, seq, redelivery from committed"))
def dedup_events(spark, sf_dir):
    rows = d.gate_observations(completed_movements(spark, sf_dir))
    valid = d.join_baselines(rows, baselines(spark))
    return d.dedup_events(valid, CONFIG.arrival).select("event_id", "seq", "redelivery")


@query(
    "dedup_against_stored",
    _sql("select event_id, seq, redelivery from committed where seq % 4 <> 1"),
)
def dedup_against_stored(spark, sf_dir):
    """Rows of a quarter of the events are already stored; their arrivals change nothing."""
    rows = d.gate_observations(completed_movements(spark, sf_dir))
    valid = d.join_baselines(rows, baselines(spark))
    stored = valid.filter("seq % 4 = 1")
    fresh = d.dedup_events(valid, CONFIG.arrival, stored)
    return fresh.select("event_id", "seq", "redelivery")


@query(
    "idle_sessions",
    _sql(
        f"""select {KEYS}, cast(session_start as varchar) as session_start,
                   cast(max(received_at) as varchar) as last_seen, count(*) as n_rows
            from sessions group by {KEYS}, session_start"""
    ),
)
def idle_sessions(spark, sf_dir):
    valid = d.join_baselines(
        d.gate_observations(completed_movements(spark, sf_dir)), baselines(spark)
    )
    rows = d.idle_sessions(d.dedup_events(valid, CONFIG.arrival), CONFIG)
    return rows.select(
        *d.WINDOW_KEY,
        F.col("session_start").cast("string").alias("session_start"),
        F.col("last_seen").cast("string").alias("last_seen"),
        "n_rows",
    )


@query(
    "rolling_mean",
    _sql(
        """select seq, redelivery, cast(session_start as varchar) as session_start,
                  n_seen >= 3 as is_full, coalesce(round(mean_seconds, 6), -1) as mean_seconds
           from rolled"""
    ),
)
def rolling_mean(spark, sf_dir):
    return _rolled(spark, sf_dir).select(
        "seq",
        "redelivery",
        F.col("session_start").cast("string").alias("session_start"),
        "is_full",
        F.coalesce("mean_seconds", F.lit(-1.0)).alias("mean_seconds"),
    )


@query(
    "full_window",
    _sql("select seq, redelivery, round(mean_seconds, 6) as mean_seconds from rolled where n_seen >= 3"),
)
def full_window(spark, sf_dir):
    rows = d.full_windows(_rolled(spark, sf_dir))
    return rows.select("seq", "redelivery", "mean_seconds")


@query(
    "breach",
    _sql("select seq, redelivery, round(mean_seconds, 6) as mean_seconds, threshold from breached"),
)
def breach(spark, sf_dir):
    rows = d.breaches(
        d.committed_windows(completed_movements(spark, sf_dir), baselines(spark), CONFIG)
    )
    return rows.select(
        "seq", "redelivery", F.round("mean_seconds", 6).alias("mean_seconds"), "threshold"
    )


@query(
    "suppress_cooldown",
    _sql(f"select {KEYS}, seq, cast(received_at as varchar) as fired_at from cooled where fires"),
)
def suppress_cooldown(spark, sf_dir):
    rolled = d.committed_windows(completed_movements(spark, sf_dir), baselines(spark), CONFIG)
    fired = d.suppress_cooldown(
        d.breaches(rolled).select(*d.WINDOW_KEY, *CONFIG.arrival, "session_start"), CONFIG
    )
    return fired.select(
        *d.WINDOW_KEY, "seq", F.col("received_at").cast("string").alias("fired_at")
    )


@query(
    "detect_congestion",
    _sql(
        f"""select alert_id, {KEYS}, event_id, round(mean_seconds, 6) as mean_seconds,
                   threshold_seconds, cast(fired_at as varchar) as fired_at from alerts"""
    ),
)
def detect_congestion(spark, sf_dir):
    alerts = d.detect_congestion(completed_movements(spark, sf_dir), baselines(spark), CONFIG)
    return alerts.select(
        "alert_id",
        *d.WINDOW_KEY,
        "event_id",
        F.round("mean_seconds", 6).alias("mean_seconds"),
        "threshold_seconds",
        F.col("fired_at").cast("string").alias("fired_at"),
    )


def _alerts_in_slices(spark, sf_dir, slices=3):
    """Alerts of slices of equal length in time, each run over the log of those before it."""
    rows = completed_movements(spark, sf_dir)
    clock = F.unix_micros(F.col("received_at").cast("timestamp"))
    first, last = rows.agg(F.min(clock), F.max(clock)).first()
    path, out = new_table_path(spark, "log"), None
    step = ((last or 0) - (first or 0)) // slices + 1
    for k in range(slices):
        mine = F.floor((clock - (first or 0)) / step) == k
        alerts = run_slice(rows.filter(mine), baselines(spark), CONFIG, path)
        out = alerts if out is None else out.unionByName(alerts)
    return out


@query(
    "detect_congestion_slices",
    _sql(
        f"""select alert_id, {KEYS}, event_id, round(mean_seconds, 6) as mean_seconds,
                   threshold_seconds, cast(fired_at as varchar) as fired_at from alerts"""
    ),
)
def detect_congestion_slices(spark, sf_dir):
    """Three slices, each given the log so far, fire the alerts of one run."""
    return _alerts_in_slices(spark, sf_dir).select(
        "alert_id",
        *d.WINDOW_KEY,
        "event_id",
        F.round("mean_seconds", 6).alias("mean_seconds"),
        "threshold_seconds",
        F.col("fired_at").cast("string").alias("fired_at"),
    )


@query(
    "suppress_cooldown_slices",
    _sql(f"select {KEYS}, seq, cast(received_at as varchar) as fired_at from cooled where fires"),
)
def suppress_cooldown_slices(spark, sf_dir):
    """Cooldowns that begin in one half of the breaches and end in the other."""
    rows = completed_movements(spark, sf_dir)
    rolled = d.committed_windows(rows, baselines(spark), CONFIG)
    breached = d.breaches(rolled).select(*d.WINDOW_KEY, *CONFIG.arrival, "session_start")
    middle = rows.agg(F.percentile_approx(F.unix_micros(F.col("received_at").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("received_at").cast("timestamp")) <= (middle or 0)
    before = d.suppress_cooldown(breached.filter(early), CONFIG)
    state = before.groupBy(*d.WINDOW_KEY).agg(F.max(F.struct("received_at", "session_start")).alias("_last"))
    state = state.select(*d.WINDOW_KEY, F.col("_last.received_at").alias("last_alert"), "_last.session_start")
    after = d.suppress_cooldown(breached.filter(~early), CONFIG, state)
    return before.unionByName(after).select(
        *d.WINDOW_KEY, "seq", F.col("received_at").cast("string").alias("fired_at")
    )


@query(
    "observation_outcome",
    _sql(
        """select g.seq, g.redelivery, coalesce(g.reject_reason,
                case when b.tenant_id is null then 'no_baseline'
                     when c.seq is null then 'duplicate'
                     when a.event_id is not null then 'alert'
                     else 'committed' end) as outcome
           from gated g
           left join baselines b using (tenant_id, site_id, aisle)
           left join committed c on c.seq = g.seq and c.redelivery = g.redelivery
           left join alerts a on a.tenant_id = g.tenant_id and a.event_id = g.event_id"""
    ),
)
def observation_outcome(spark, sf_dir):
    rows = d.observation_outcome(completed_movements(spark, sf_dir), baselines(spark), CONFIG)
    return rows.select("seq", "redelivery", "outcome")
