from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wavetrail.operators import outbox, receipts, tables, tenancy

NOW = datetime(2024, 1, 1, 12)
SCHEMA = (
    "tenant_id string, alert_id string, created_at timestamp, delivered_at timestamp, last_error string,"
    "attempts bigint, next_attempt_at timestamp, dead boolean"
)


def alert(name, tenant="a", delivered=None, attempts=0, due=None, dead=False, age=1):
    return (tenant, name, NOW - timedelta(hours=age), delivered, "", attempts, due, dead)


def frames(spark, alerts, outcomes=()):
    return (
        spark.createDataFrame(alerts, SCHEMA),
        spark.createDataFrame(list(outcomes), "tenant_id string, alert_id string, ok boolean, error string"),
        spark.createDataFrame([("t" * 16, "a")], "token string, tenant_id string"),
    )


def names(rows):
    return sorted(r.alert_id for r in rows.collect())


def test_pending_boundaries(spark):
    rows, _, _ = frames(spark, [
        alert("new"), alert("sent", delivered=NOW), alert("dead", dead=True), alert("due", due=NOW),
        alert("later", due=NOW + timedelta(microseconds=1)),
    ])
    assert names(outbox.pending_alerts(rows, F.lit(NOW))) == ["due", "new"]


def test_top_k_takes_the_oldest_per_tenant(spark):
    rows, _, _ = frames(spark, [alert(f"x{i}", age=i) for i in range(5)] + [alert("y", tenant="b")])
    assert names(outbox.pending_top_k(rows, F.lit(NOW), 2)) == ["x3", "x4", "y"]


@pytest.mark.parametrize("ok", [True, False])
def test_success_and_dead_letter_end_the_retries(spark, ok):
    rows, outcomes, tokens = frames(spark, [alert("one"), alert("other", tenant="b")],
                                    [("a", "one", ok, "closed"), ("b", "other", True, "")])
    after = outbox.dispatch_pass(rows, outcomes, tokens, F.lit(NOW), max_attempts=1)
    state = {r.alert_id: r for r in after.collect()}
    one = state["one"]
    if ok:
        assert (one.delivered_at, one.last_error, one.attempts, one.dead) == (NOW, "", 0, False)
    else:
        assert (one.delivered_at, one.last_error, one.attempts, one.dead) == (None, "closed", 1, True)
        assert one.next_attempt_at == NOW + timedelta(seconds=2)
    assert state["other"].delivered_at is None  # its tenant has no token
    again = outbox.attempted(after, outcomes, tokens, F.lit(NOW + timedelta(days=1)))
    assert again.count() == 0
    report = outbox.dispatch_failures(rows, outcomes, tokens, F.lit(NOW)).collect()
    assert [r.message for r in report] == ([] if ok else ["alert one: closed"])


def test_unknown_alert_is_reported(spark):
    rows, outcomes, tokens = frames(spark, [alert("one")], [("a", "gone", True, "")])
    assert names(outbox.unmatched(rows, outcomes)) == ["gone"]
    report = outbox.dispatch_failures(rows, outcomes, tokens, F.lit(NOW)).first()
    assert report.message == "alert not found"


def test_truncation_counts_bytes(spark):
    texts = ["short", "a" * 2000, "a" * 2001, "é" * 1001, "x" + "é" * 1000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(outbox.truncate_error(F.col("t"))).collect()]
    assert got == ["short", "a" * 2000, "a" * 2000, "é" * 1000, "x" + "é" * 999]


def test_log_state_equals_repeated_passes(spark):
    rows, _, tokens = frames(spark, [alert("one"), alert("two")])
    log, state = [], rows
    for i in range(4):
        at = NOW + timedelta(hours=i)
        results = [("a", "one", i == 3, f"e{i}"), ("a", "two", False, f"f{i}")]
        due = {r.alert_id for r in outbox.pending_alerts(state, F.lit(at)).collect()}
        log += [(t, n, at, ok, e) for t, n, ok, e in results if n in due]
        outcomes = spark.createDataFrame(results, "tenant_id string, alert_id string, ok boolean, error string")
        state = outbox.dispatch_pass(state, outcomes, tokens, F.lit(at), max_attempts=3).checkpoint()
    attempts = spark.createDataFrame(log, "tenant_id string, alert_id string, at timestamp, ok boolean, error string")
    derived = outbox.outbox_state(rows, attempts, max_attempts=3)
    as_rows = lambda f: sorted(tuple(r) for r in f.select(*rows.columns).collect())
    by_name = lambda f: {r.alert_id: tuple(r) for r in f.select(*rows.columns).collect()}
    # a third failure makes both alerts dead, so the fourth attempt is never made
    assert by_name(derived) == by_name(state) and as_rows(derived) == as_rows(state)


def test_receipts_are_idempotent(spark):
    schema = "tenant_id string, workflow_id string, run_id string, task_id string, n int"
    rows = spark.createDataFrame([("a", "w", "r", "p1", 2), ("a", "w", "r", "p1", 1), ("a", "w", "r", "p2", 3)], schema)
    first = receipts.record_receipts(rows, ["n"])
    assert sorted((r.task_id, r.n) for r in first.collect()) == [("p1", 1), ("p2", 3)]
    assert receipts.record_receipts(rows, ["n"], first).count() == 0
    assert receipts.uniqueness_violations(rows, receipts.RECEIPT_KEY).first().copies == 2


def test_tenant_rules(spark):
    rows, _, _ = frames(spark, [alert("one"), alert("two", tenant="b")])
    assert names(tenancy.tenant_scope(rows, "a")) == ["one"]
    assert tenancy.tenant_scope(rows, None).count() == 0
    with pytest.raises(ValueError):
        tenancy.tenant_scope(rows, "a\n")
    with pytest.raises(PermissionError):
        tenancy.require_tenant_rows(rows, "a")
    changed = rows.withColumn("attempts", F.lit(9)).withColumn("created_at", F.lit(NOW))
    got = tenancy.immutable_columns(rows, changed, key=("alert_id",)).collect()
    assert {tuple(r.changed) for r in got} == {("created_at",)}
    log = rows.withColumn("alert", F.struct(F.lit("a").alias("tenant_id")))
    assert names(tenancy.pair_violations(log)) == ["two"]


def test_bulk_insert_is_all_or_nothing(spark):
    schema = "tenant_id string, workflow_id string, run_id string, task_id string, aisle string"
    task_ids = spark.createDataFrame([("p1",)], "task_id string")
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    now = F.lit(NOW)
    stored = tables.create_bulk(
        tables.with_defaults(make(), "process_tasks", now), make(("a", "w", "r", "p1", "A")), "process_tasks", now, task_ids
    )
    assert stored.count() == 1 and stored.first().created_at == NOW
    for bad in (("", "w", "r2", "p1", "A"), ("a", None, "r2", "p1", "A"), ("a", "w", "r2", "p9", "A")):
        with pytest.raises(ValueError):
            tables.create_bulk(stored, make(bad, ("a", "w", "r3", "p1", "A")), "process_tasks", now, task_ids)
    with pytest.raises(ValueError, match="duplicate"):
        tables.create_bulk(stored, make(("a", "w", "r", "p1", "B")), "process_tasks", now, task_ids)


def test_single_row_changes(spark):
    rows, _, _ = frames(spark, [alert("one"), alert("two", attempts=3)])
    is_two = F.col("alert_id") == "two"
    got = tables.update_one(rows, is_two, {"attempts": F.col("attempts") + 1, "last_error": None})
    assert {r.alert_id: (r.attempts, r.last_error) for r in got.collect()} == {"one": (0, ""), "two": (4, None)}
    assert names(tables.delete_one(rows, is_two)) == ["one"]
    absent = F.col("alert_id") == "none"
    for call in (lambda: tables.update_one(rows, absent, {}), lambda: tables.delete_one(rows, absent),
                 lambda: tables.require_first(rows.filter(absent))):
        with pytest.raises(LookupError):
            call()
    with pytest.raises(ValueError):
        tables.require_one(rows)
    # unknown is no match: rows without a due time stay
    assert names(tables.delete_where(rows, F.col("next_attempt_at") < F.lit(NOW))) == ["one", "two"]
