import random
from datetime import datetime, timedelta

import pytest

from tests.reference_detector import outcomes
from wavetrail.operators import detector as d
from wavetrail.sources.incremental import run_slice
from wavetrail.sources.sinks import observation_log

SCHEMA = (
    "tenant_id string, site_id string, aisle string, workflow_id string, run_id string, task_id string,"
    "event_id string, seconds double, observed_at timestamp, received_at timestamp, seq int"
)
BASELINE_SCHEMA = "tenant_id string, site_id string, aisle string, mean double, stddev double"
T0 = datetime(2024, 1, 1)
ARRIVAL = ("received_at", "seq")


def row(seq, seconds, tenant="a", aisle="A01", event=None, at=0.0, run="run", observed=None):
    received = T0 + timedelta(seconds=at)
    event = event if event is not None else f"e{seq}"
    return (
        tenant, "s", aisle, f"picking/{tenant}/w", run, event or "x", event, float(seconds),
        received if observed is None else observed, received, seq,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def base(spark, *rows):
    return spark.createDataFrame(rows or [("a", "s", "A01", 10.0, 2.0), ("b", "s", "A01", 100.0, 2.0)], BASELINE_SCHEMA)


def alerts(spark, rows, config=None, baselines=None):
    config = config or d.DetectorConfig(arrival=ARRIVAL, idle_ttl=timedelta(seconds=60))
    out = d.detect_congestion(frame(spark, rows), baselines or base(spark), config)
    return sorted((r.event_id, r.mean_seconds, r.threshold_seconds) for r in out.collect())


def test_dedup_isolation_and_cooldown(spark):
    rows = [
        row(1, 20, event="one"), row(2, 20, event="one"), row(3, 20, tenant="b", event="one"),
        row(4, 20, event="two"), row(5, 20, event="three"), row(6, 30, event="four"),
    ]
    assert alerts(spark, rows) == [("three", 20.0, 15.0)]


def test_mean_equal_to_threshold_fires(spark):
    assert alerts(spark, [row(i, 15) for i in range(3)]) == [("e2", 15.0, 15.0)]


def test_runs_and_aisles_do_not_share_windows(spark):
    rows = [row(1, 20), row(2, 20, run="other"), row(3, 20, aisle="A02"), row(4, 20)]
    baselines = base(spark, ("a", "s", "A01", 10.0, 2.0), ("a", "s", "A02", 10.0, 2.0))
    assert alerts(spark, rows, baselines=baselines) == []


def test_boundaries_of_cooldown_and_idle_ttl(spark):
    config = d.DetectorConfig(arrival=ARRIVAL, cooldown=timedelta(seconds=60), idle_ttl=timedelta(seconds=30))
    rows = [row(i, 20, at=30 * i) for i in range(6)]  # gaps equal to the ttl keep the window
    assert [a[0] for a in alerts(spark, rows, config)] == ["e2", "e4"]
    rows = [row(i, 20, at=30.000001 * i) for i in range(6)]  # longer gaps reset it
    assert alerts(spark, rows, config) == []


def test_gate_reasons(spark):
    late = T0 - timedelta(minutes=5)
    rows = [
        row(1, 5), row(2, -1), row(3, 0), row(4, float("nan")), row(5, float("inf")), row(6, 3600),
        row(7, 3601), row(8, 5, event=""), row(9, 5, aisle="A 1"), row(10, 5, observed=late),
        row(11, 5, observed=late - timedelta(microseconds=1)),
        row(12, 5, observed=T0 + timedelta(minutes=1)),
        row(13, 5, observed=T0 + timedelta(minutes=1, microseconds=1)),
    ]
    bad = {r.seq: r.reject_reason for r in d.gate_rejects(frame(spark, rows)).collect()}
    assert bad == {
        2: "invalid_duration", 3: "invalid_duration", 4: "invalid_duration", 5: "invalid_duration",
        7: "invalid_duration", 8: "invalid_id", 9: "invalid_id", 11: "stale_or_future",
        13: "stale_or_future",
    }


def test_baseline_rules(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "s", "A", 1.0, 1.0), ("a b", "s", "A", 1.0, 1.0), ("a", "s", "B", 0.0, 1.0),
            ("a", "s", "C", 1.0, nan), ("a", "s", "D", inf, 1.0)]
    got = {(r.tenant_id, r.aisle): r.violation for r in d.validate_baselines(base(spark, *rows), 2.5).collect()}
    assert got == {("a b", "A"): "invalid_id", ("a", "B"): "invalid_mean", ("a", "C"): "invalid_stddev",
                   ("a", "D"): "infinite_threshold"}
    with pytest.raises(ValueError, match="duplicate"):
        d.require_baselines(base(spark, rows[0], rows[0]), 2.5)
    with pytest.raises(ValueError, match="at least one"):
        d.require_baselines(base(spark).limit(0), 2.5)


@pytest.mark.parametrize(
    "bad",
    [dict(window=1), dict(window=101), dict(sigma=0), dict(sigma=float("nan")),
     dict(cooldown=timedelta(0)), dict(idle_ttl=timedelta(0))],
)
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        d.DetectorConfig(**bad)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 0, 1, 5, 20, 20, 40, 90])
        hot = rng.random() < 0.6  # one run holds most rows
        event = f"e{rng.randrange(i // 2, i + 1)}" if rng.random() < 0.3 else f"n{i}"
        r = row(i, rng.choice([5, 12, 15, 16, 20, 40, -1]), tenant="a" if hot else rng.choice("abc"),
                aisle="A01", event=event, at=at, run="hot" if hot else rng.choice(["r1", "r2"]))
        rows.append(r)
    return rows


@pytest.mark.parametrize(
    "seed, plan",
    [(1, {}), (2, dict(heavy_rows=30, chunk_rows=13)),
     (3, dict(heavy_rows=20, chunk_rows=7, fold_rows=3)), (4, dict(fold_rows=2, window=5))],
)
def test_every_plan_equals_brute_force(spark, seed, plan):
    config = d.DetectorConfig(
        **{"window": 3, **plan}, arrival=ARRIVAL, cooldown=timedelta(seconds=60), idle_ttl=timedelta(seconds=80)
    )
    rows = random_rows(seed)
    names = [c.split()[0] for c in SCHEMA.split(",")]
    want = outcomes(
        [dict(zip(names, r)) for r in rows],
        {("a", "s", "A01"): (10.0, 2.0), ("b", "s", "A01"): (8.0, 1.0)},
        config,
    )
    baselines = base(spark, ("a", "s", "A01", 10.0, 2.0), ("b", "s", "A01", 8.0, 1.0))
    got = d.observation_outcome(frame(spark, rows), baselines, config)
    assert [r.outcome for r in got.orderBy("seq").collect()] == want
    assert want.count("alert") > 3


def test_stored_events_change_nothing(spark):
    rows = frame(spark, [row(1, 20), row(2, 20), row(3, 20)])
    stored = frame(spark, [row(9, 1, event="e2")])
    assert {r.event_id for r in d.dedup_events(rows, ARRIVAL, stored).collect()} == {"e1", "e3"}


@pytest.mark.parametrize("heavy_rows", [1, 1_000_000])
def test_an_event_counts_once_whatever_the_size_of_its_runs(spark, heavy_rows):
    """The same event id in two runs: the first arrival counts, in ordinary and in heavy runs."""
    rows = [row(1, 20, event="x"), row(2, 20, event="x", run="other"), row(3, 20, event="y", run="other"),
            row(4, 20, event="y"), row(5, 20, event="z"), row(6, 20, event="z", run="third")]
    config = d.DetectorConfig(arrival=ARRIVAL, heavy_rows=heavy_rows, chunk_rows=1)
    done = d.committed_windows(frame(spark, rows), base(spark), config)
    assert sorted(r.seq for r in done.collect()) == [1, 3, 5]


def test_a_second_batch_meets_the_stored_events(spark):
    first, second = [row(i, 20) for i in range(3)], [row(i, 20) for i in range(5)]
    config = d.DetectorConfig(arrival=ARRIVAL)
    log = d.committed_windows(frame(spark, first), base(spark), config)
    again = d.committed_windows(frame(spark, second), base(spark), config, log)
    assert sorted(r.seq for r in again.collect()) == [3, 4]


def brute_alerts(rows, config, known):
    names = [c.split()[0] for c in SCHEMA.split(",")]
    told = outcomes([dict(zip(names, r)) for r in rows], known, config)
    return sorted(r[6] for r, o in zip(rows, told) if o == "alert")


@pytest.mark.parametrize(
    "seed, plan", [(5, {}), (6, dict(heavy_rows=25, chunk_rows=9)), (7, dict(heavy_rows=10, chunk_rows=4, fold_rows=2, window=5))]
)
def test_slices_over_a_log_fire_the_alerts_of_one_run(spark, tmp_path, seed, plan):
    config = d.DetectorConfig(
        **{"window": 3, **plan}, arrival=ARRIVAL, cooldown=timedelta(seconds=60), idle_ttl=timedelta(seconds=80)
    )
    rows = random_rows(seed)
    known = {("a", "s", "A01"): (10.0, 2.0), ("b", "s", "A01"): (8.0, 1.0)}
    baselines = base(spark, *[(*k, *v) for k, v in known.items()])
    path, got, state = str(tmp_path / "log"), [], None
    cuts = [0, 90, 91, 250, len(rows)]
    for low, high in zip(cuts, cuts[1:]):
        part = frame(spark, rows[low:high])
        before = spark.read.parquet(path) if low else None
        alerts = run_slice(part, baselines, config, path)
        got += [r.event_id for r in alerts.collect()]
        assert run_slice(part, baselines, config, path).isEmpty()  # given again: nothing happens
        log = spark.read.parquet(path)
        fresh = log if before is None else log.join(before, ["tenant_id", "event_id"], "left_anti")
        whole = d.window_state(log, config)
        state = whole if state is None else d.advance_state(state, fresh, config)
        plain = d.window_state(log.drop("session_start", "is_full", "mean_seconds"), config)
        told = [sorted(map(str, x.select(sorted(x.columns)).collect())) for x in (whole, state, plain)]
        assert told[0] == told[1] == told[2]
    assert sorted(got) == brute_alerts(rows, config, known) and len(got) > 3


def test_a_kept_state_stands_for_the_log(spark):
    config = d.DetectorConfig(arrival=ARRIVAL, cooldown=timedelta(seconds=60), idle_ttl=timedelta(seconds=50))
    rows = [row(i, 20, at=20 * i) for i in range(12)]
    first = d.committed_windows(frame(spark, rows[:5]), base(spark), config)
    log = observation_log(first, d.alerts_of_windows(first, config))
    state = d.window_state(log, config)
    again = d.detect_congestion(frame(spark, rows[3:]), base(spark), config, log, state)
    assert sorted(r.event_id for r in again.collect()) == ["e11", "e5", "e8"]
    paused = [row(99, 20, at=20 * 4 + 51), row(100, 20, at=132), row(101, 20, at=133)]  # a new session rearms
    assert [r.event_id for r in d.detect_congestion(frame(spark, paused), base(spark), config, log).collect()] == ["e101"]


def test_outcomes_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "in")
    frame(spark, random_rows(8, 50)).write.parquet(path)
    config = d.DetectorConfig(arrival=ARRIVAL)
    plan = d.ranked_entries(spark.read.schema(SCHEMA).parquet(path), base(spark), config)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    out = d.observation_outcome(spark.read.schema(SCHEMA).parquet(path), base(spark), config)
    assert path not in out._jdf.queryExecution().executedPlan().toString()  # the rest reads what was written
    assert out.columns[:-1] == [c.split()[0] for c in SCHEMA.split(",")] and out.count() == 50
