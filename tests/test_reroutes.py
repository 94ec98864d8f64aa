from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wavetrail.operators import reroutes as rr

T0 = datetime(2024, 1, 1)
RUN = ("demo", "hall", "picking/demo/w", "run-1")
STEP_SCHEMA = (
    "tenant_id string, site_id string, workflow_id string, run_id string, hop int, step_id string,"
    "aisle string, alternative string, started_at timestamp"
)
SIGNAL_SCHEMA = (
    "alert_id string, tenant_id string, site_id string, workflow_id string, run_id string, aisle string,"
    "received_at timestamp"
)


def minute(n):
    return T0 + timedelta(minutes=n)


def frames(spark, steps, signals):
    return (
        spark.createDataFrame([(*RUN, i, s, a, alt, at) for i, (s, a, alt, at) in enumerate(steps, 1)], STEP_SCHEMA),
        spark.createDataFrame(signals, SIGNAL_SCHEMA),
    )


def signal(alert="good", aisle="A01", at=1.5, **kw):
    run = dict(zip(("tenant_id", "site_id", "workflow_id", "run_id"), RUN)) | kw
    return (alert, *run.values(), aisle, minute(at))


STEPS = [("p1", "A01", "A02", minute(1)), ("p2", "A01", "A02", minute(2)), ("pack", "PACK", "", minute(3))]


def test_forged_and_repeated_signals_are_ignored(spark):
    forged = [signal("f1", tenant_id="other"), signal("f2", run_id="old"), signal("f3", site_id="x"),
              signal("f4", workflow_id="wrong"), signal(""), signal("f5", aisle="Z")]
    steps, signals = frames(spark, STEPS, [*forged, signal(), signal(at=1.6, aisle="PACK")])
    accepted = rr.accept_signals(steps, signals)
    assert [(r.alert_id, r.aisle) for r in accepted.collect()] == [("good", "A01")]
    r = rr.run_results(steps, accepted, F.lit(minute(9))).first()
    assert (r.completed, r.aisles, r.n_accepted) == (["p1", "p2", "pack"], ["A01", "A02", "PACK"], 1)
    alerts = rr.run_accepted_alerts(steps, accepted, F.lit(minute(9))).collect()
    assert [(a.place, a.alert_id, a.received_at) for a in alerts] == [(1, "good", minute(1.5))]


def test_signal_at_the_boundary_counts_and_after_the_last_step_does_not(spark):
    steps, signals = frames(spark, STEPS, [signal("a", at=1), signal("late", aisle="PACK", at=3.1)])
    accepted = rr.accept_signals(steps, signals)
    r = rr.run_results(steps, accepted, F.lit(minute(9))).first()
    assert (r.aisles, r.n_accepted) == (["A02", "A02", "PACK"], 1)


def test_no_open_aisle_stops_the_run(spark):
    for signals in ([signal("s", aisle="PACK", at=0)], [signal("x", at=0), signal("y", aisle="A02", at=1.5)]):
        steps, signals = frames(spark, STEPS, signals)
        accepted = rr.accept_signals(steps, signals)
        stop = rr.route_unavailable(steps, accepted, F.lit(minute(9))).first()
        done = rr.apply_reroutes(steps, accepted, F.lit(minute(9))).count()
        assert done == stop.hop - 1
        assert rr.run_results(steps, accepted, F.lit(minute(9))).count() == 0


def test_steps_not_started_use_as_of(spark):
    waiting = [(s, a, alt, None) for s, a, alt, _ in STEPS]
    steps, signals = frames(spark, waiting, [signal(at=5)])
    accepted = rr.accept_signals(steps, signals)
    taken = lambda at: [r.taken for r in rr.planned_steps(steps, accepted, F.lit(at)).orderBy("hop").collect()]
    assert taken(minute(4)) == ["A01", "A01", "PACK"]
    assert taken(minute(5)) == ["A02", "A02", "PACK"]
    # nothing has happened yet: no step is executed, no run is finished or lacks a reroute
    assert rr.apply_reroutes(steps, accepted, F.lit(minute(9))).isEmpty()
    results = rr.run_results(steps, accepted, F.lit(minute(9)))
    assert results.isEmpty() and rr.reroute_missing(results).isEmpty()


def test_runs_without_reroute_are_named(spark):
    steps, signals = frames(spark, STEPS, [signal(aisle="Z")])
    results = rr.run_results(steps, rr.accept_signals(steps, signals), F.lit(minute(9)))
    assert rr.reroute_missing(results).count() == 1


def test_aisles_of_routes_as_arrays_are_those_of_their_steps(spark):
    from wavetrail.operators import routes

    waves = spark.createDataFrame(
        [("t", "s", "w", "p", [("a", "A1", "B1"), ("b", "A1", ""), ("c", None, "C1"), ("d", "A2", None)]),
         ("t", "s", "w", "p", [("a", "A1", "D1")]), ("t", "s", "v", "p", [])],
        "tenant_id string, site_id string, wave_id string, process_id string,"
        "steps array<struct<id:string,aisle:string,alternative:string>>",
    )
    runs = waves.withColumns({"workflow_id": F.col("wave_id"), "run_id": F.lit("r")})
    steps = routes.resolved_steps(waves).withColumns({"workflow_id": F.col("wave_id"), "run_id": F.lit("r")})
    got = sorted(map(tuple, rr.route_aisles(runs).collect()))
    assert got == sorted(map(tuple, rr.allowed_aisles(steps).collect()))
    assert [r[-1] for r in got] == ["A1", "A2", "B1", "C1", "D1"]
