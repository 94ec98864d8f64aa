"""Queries of the outbox, receipts and tenant rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.functions.identity import retry_delay_seconds
from wavetrail.operators import outbox, receipts, tenancy
from wavetrail.plans import stored
from wavetrail.plans.movements import with_
from wavetrail.plans.registry import query
from wavetrail.plans.stored import ALERTS_SQL, NOW_TEXT, OUTBOX_SQL, RECEIPTS_SQL
from wavetrail.session import new_table_path
from wavetrail.streaming import delivery

STATE_SQL = """tenant_id, alert_id, coalesce(cast(delivered_at as varchar), '') as delivered_at,
    last_error, attempts, coalesce(cast(next_attempt_at as varchar), '') as next_attempt_at, dead"""


def _sql(select: str) -> str:
    return with_(OUTBOX_SQL, select)


def _state(rows):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(
        "tenant_id", "alert_id", text("delivered_at"), "last_error",
        F.col("attempts").cast("long").alias("attempts"), text("next_attempt_at"), "dead",
    )


@query("pending_alerts", _sql("select tenant_id, alert_id, attempts from pending"))
def pending_alerts(spark, sf_dir):
    rows = outbox.pending_alerts(stored.alerts(spark, sf_dir), stored.now())
    return rows.select("tenant_id", "alert_id", "attempts")


@query(
    "pending_top_k",
    _sql(
        """select tenant_id, alert_id from (
             select *, row_number() over (partition by tenant_id order by created_at, alert_id) as rn
             from pending) where rn <= 100"""
    ),
)
def pending_top_k(spark, sf_dir):
    rows = outbox.pending_top_k(stored.alerts(spark, sf_dir), stored.now())
    return rows.select("tenant_id", "alert_id")


@query("dispatch_scope", _sql("select tenant_id, alert_id from alerts where tenant_id in ('t0', 't1')"))
def dispatch_scope(spark, sf_dir):
    rows = outbox.dispatch_scope(stored.alerts(spark, sf_dir), stored.tokens(spark))
    return rows.select("tenant_id", "alert_id")


@query(
    "mark_delivered",
    _sql(
        f"""select {STATE_SQL} from (
              select a.* exclude (delivered_at, last_error),
                     case when o.ok then timestamp '{NOW_TEXT}' else delivered_at end as delivered_at,
                     case when o.ok then '' else last_error end as last_error
              from alerts a left join outcomes o using (tenant_id, alert_id))"""
    ),
)
def mark_delivered(spark, sf_dir):
    ids = stored.outcomes(spark, sf_dir).filter("ok")
    return _state(outbox.mark_delivered(stored.alerts(spark, sf_dir), ids, stored.now()))


@query(
    "mark_delivered_unmatched",
    _sql(
        """select tenant_id, alert_id from outcomes where ok
           and (tenant_id, alert_id) not in (select tenant_id, alert_id from alerts)"""
    ),
)
def mark_delivered_unmatched(spark, sf_dir):
    ids = stored.outcomes(spark, sf_dir).filter("ok").select("tenant_id", "alert_id")
    return outbox.unmatched(stored.alerts(spark, sf_dir), ids)


FAILED_COLUMNS = f"""
    case when hit then cut_error else last_error end as last_error,
    case when hit then attempts + 1 else attempts end as attempts,
    case when hit then attempts + 1 >= 8 else dead end as dead,
    case when hit then timestamp '{NOW_TEXT}'
         + cast(pow(2, least(attempts + 1, 6)) as integer) * interval '1' second
         else next_attempt_at end as next_attempt_at"""


@query(
    "mark_failed",
    _sql(
        f"""select {STATE_SQL} from (
              select tenant_id, alert_id, delivered_at, {FAILED_COLUMNS}
              from (select a.*, o.alert_id is not null as hit,
                           case when o.error like 'e%' then left(o.error, 2000)
                                else left(o.error, 1000) end as cut_error
                    from alerts a
                    left join outcomes o on a.tenant_id = o.tenant_id
                      and a.alert_id = o.alert_id and not o.ok))"""
    ),
)
def mark_failed(spark, sf_dir):
    failures = stored.outcomes(spark, sf_dir).filter("not ok")
    return _state(outbox.mark_failed(stored.alerts(spark, sf_dir), failures, stored.now()))


@query(
    "retry_delay",
    _sql(
        """select alert_id, cast(pow(2, least(attempts + 1, 6)) as integer) as delay_seconds
           from alerts"""
    ),
)
def retry_delay(spark, sf_dir):
    delay = retry_delay_seconds(F.col("attempts") + 1).alias("delay_seconds")
    return stored.alerts(spark, sf_dir).select("alert_id", delay)


@query(
    "truncate_error",
    _sql(
        """select alert_id, cut_error, strlen(cut_error) as n_bytes
           from (select alert_id, case when strlen(error) <= 2000 then error
                   when error like 'e%' then left(error, 2000) else left(error, 1000) end as cut_error
                 from outcomes)"""
    ),
)
def truncate_error(spark, sf_dir):
    rows = stored.outcomes(spark, sf_dir)
    cut = rows.select("alert_id", outbox.truncate_error(F.col("error")).alias("cut_error"))
    return cut.withColumn("n_bytes", F.octet_length("cut_error").cast("long"))


@query(
    "dead_letter",
    _sql(
        """select a.tenant_id, alert_id, a.attempts + 1 as attempts
           from alerts a join outcomes o using (tenant_id, alert_id)
           where delivered_at is null and not o.ok and a.attempts + 1 >= 8"""
    ),
)
def dead_letter(spark, sf_dir):
    failures = stored.outcomes(spark, sf_dir).filter("not ok")
    updated = outbox.mark_failed(stored.alerts(spark, sf_dir), failures, stored.now())
    failed_ids = failures.select("tenant_id", "alert_id")
    dead = outbox.dead_letters(updated).join(failed_ids, ["tenant_id", "alert_id"], "left_semi")
    return dead.select("tenant_id", "alert_id", "attempts")


@query(
    "dispatch_pass",
    _sql(
        f"""select {STATE_SQL} from (
              select tenant_id, alert_id,
                     case when delivered then timestamp '{NOW_TEXT}' else delivered_at end as delivered_at,
                     case when delivered then '' when hit then cut_error else last_error end as last_error,
                     case when hit then attempts + 1 else attempts end as attempts,
                     case when hit then attempts + 1 >= 8 else dead end as dead,
                     case when hit then timestamp '{NOW_TEXT}'
                            + cast(pow(2, least(attempts + 1, 6)) as integer) * interval '1' second
                          else next_attempt_at end as next_attempt_at
              from (select a.*, coalesce(not t.ok, false) as hit, coalesce(t.ok, false) as delivered,
                           cut_error
                    from alerts a left join tried t using (tenant_id, alert_id)))"""
    ),
)
def dispatch_pass(spark, sf_dir):
    rows = outbox.dispatch_pass(
        stored.alerts(spark, sf_dir), stored.outcomes(spark, sf_dir), stored.tokens(spark), stored.now()
    )
    return _state(rows)


@query(
    "dispatch_failures",
    _sql(
        """select tenant_id, alert_id, 'alert ' || alert_id || ': ' || error as message
           from tried where not ok
           union all
           select tenant_id, alert_id, 'alert not found' from outcomes
           where (tenant_id, alert_id) not in (select tenant_id, alert_id from alerts)"""
    ),
)
def dispatch_failures(spark, sf_dir):
    return outbox.dispatch_failures(
        stored.alerts(spark, sf_dir), stored.outcomes(spark, sf_dir), stored.tokens(spark), stored.now()
    )


@query(
    "outbox_state",
    with_(
        ALERTS_SQL
        + """,
log as (
  select 't' || o_custkey % 3 as tenant_id, 'al_' || l_orderkey as alert_id,
         l_shipdate + l_linenumber * interval '1' minute as tried_at,
         l_linenumber = 7 and l_partkey % 2 = 0 as ok, 'E' || l_partkey as error
  from lineitem join orders on l_orderkey = o_orderkey
),
last_failure as (
  select tenant_id, alert_id, tried_at, error from (
    select *, row_number() over (partition by tenant_id, alert_id order by tried_at desc, error desc) as rn
    from log where not ok) where rn = 1
),
counts as (
  select tenant_id, alert_id, count(*) filter (not ok) as n_failed, min(tried_at) filter (ok) as delivered
  from log group by all
)""",
        f"""select {STATE_SQL} from (
              select a.tenant_id, a.alert_id, c.delivered as delivered_at,
                     case when c.delivered is not null then '' else coalesce(f.error, '') end as last_error,
                     coalesce(n_failed, 0) as attempts,
                     f.tried_at + cast(pow(2, least(n_failed, 6)) as integer) * interval '1' second
                       as next_attempt_at,
                     coalesce(n_failed, 0) >= 8 as dead
              from alerts a
              left join counts c using (tenant_id, alert_id)
              left join last_failure f using (tenant_id, alert_id))""",
    ),
)
def outbox_state(spark, sf_dir):
    rows = outbox.outbox_state(stored.alerts(spark, sf_dir), stored.attempts(spark, sf_dir))
    return _state(rows)


# three passes: the failures of the first two are due again in the third
PASS_TIMES = ("2000-01-01 00:00:00", "2000-01-01 00:00:01", "2000-01-01 00:00:10")


@query(
    "dispatch_loop",
    f"""with alerts as (
          select 't' || o_custkey % 3 as tenant_id, 'al_' || o_orderkey as alert_id, o_orderkey,
                 row_number() over (partition by o_custkey % 3 order by o_orderdate, 'al_' || o_orderkey) as rn
          from orders),
        third as (
          select alert_id from (
            select alert_id, row_number() over (partition by tenant_id order by rn) as place
            from alerts where tenant_id <> 't2' and (rn > 200 or o_orderkey % 4 = 0))
          where place <= 100),
        log as (
          select tenant_id, alert_id, o_orderkey, n, timestamp '2000-01-01 00:00:00' + n * interval '1' second as tried_at
          from (select *, case when rn <= 100 then 0 when rn <= 200 then 1 end as n from alerts)
          where n is not null and tenant_id <> 't2'
          union all
          select tenant_id, alert_id, o_orderkey, 10, timestamp '2000-01-01 00:00:10'
          from alerts where alert_id in (select alert_id from third)),
        sums as (
          select alert_id, count(*) filter (o_orderkey % 4 = 0) as failed,
                 max(tried_at) filter (o_orderkey % 4 = 0) as last_at,
                 min(tried_at) filter (o_orderkey % 4 <> 0) as done
          from log group by 1)
        select {STATE_SQL} from (
          select tenant_id, alert_id, done as delivered_at, case when failed > 0 then 'busy' else '' end as last_error,
                 coalesce(failed, 0) as attempts, false as dead,
                 last_at + cast(pow(2, failed) as integer) * interval '1' second as next_attempt_at
          from alerts left join sums using (alert_id))""",
)
def dispatch_loop(spark, sf_dir):
    """Three passes as a stream of ticks, then the state of the outbox from its attempt log."""
    ticks, path, memory = (new_table_path(spark, n) for n in ("ticks", "attempts", "passes"))
    for t in PASS_TIMES:  # one after another: the stream takes files in the order of their modification
        time = spark.createDataFrame([(t,)], "at string").select(F.col("at").cast("timestamp_ntz"))
        time.coalesce(1).write.mode("append").parquet(ticks)
    alerts, number = stored.alerts(spark, sf_dir), F.substring_index("alert_id", "_", -1).cast("long")

    def signal(chosen):
        failed = number % 4 == 0
        return chosen.select(
            "tenant_id", "alert_id", (~failed).alias("ok"), F.when(failed, "busy").otherwise("").alias("error"))

    stream = spark.readStream.schema("at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(ticks)
    delivery.dispatch_stream(stream, lambda: alerts, path, signal, stored.tokens(spark), memory)
    return _state(outbox.outbox_state(alerts, delivery.read_attempts(spark, path)))


# --- receipts -------------------------------------------------------------

RECEIPT_COLUMNS = ("tenant_id", "workflow_id", "run_id", "task_id", "aisle", "l_suppkey", "l_partkey")
FIRST_RECEIPTS = """
    select * from (
      select *, row_number() over (
          partition by tenant_id, workflow_id, run_id, task_id
          order by l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice) as rn
      from receipts) where rn = 1"""


@query(
    "record_receipts",
    with_(
        RECEIPTS_SQL,
        f"""select {', '.join(RECEIPT_COLUMNS)} from ({FIRST_RECEIPTS}) r
            where not exists (select 1 from receipts s where s.l_suppkey % 11 = 3
              and s.tenant_id = r.tenant_id and s.workflow_id = r.workflow_id
              and s.run_id = r.run_id and s.task_id = r.task_id)""",
    ),
)
def record_receipts(spark, sf_dir):
    rows = stored.receipts(spark, sf_dir)
    kept = receipts.record_receipts(rows, stored.RECEIPT_ARRIVAL, rows.filter("l_suppkey % 11 = 3"))
    return kept.select(*RECEIPT_COLUMNS)


@query(
    "check_task_enum",
    with_(
        RECEIPTS_SQL,
        "select tenant_id, workflow_id, task_id, count(*) as n_rows from receipts "
        "where task_id not in ('pick_01','pick_02','pick_03','pick_04','pick_05','pick_06') group by all",
    ),
)
def check_task_enum(spark, sf_dir):
    bad = receipts.check_task_enum(stored.receipts(spark, sf_dir), stored.task_ids(spark))
    return bad.groupBy("tenant_id", "workflow_id", "task_id").agg(F.count("*").alias("n_rows"))


@query(
    "receipt_identity",
    with_(
        RECEIPTS_SQL,
        """select workflow_id, wave_id, count(*) as n_rows from receipts
           where regexp_matches(wave_id, '^[A-Za-z0-9_-]{1,64}$')
             and workflow_id = 'picking/' || tenant_id || '/' || wave_id group by all""",
    ),
)
def receipt_identity(spark, sf_dir):
    rows = receipts.receipt_identity(stored.receipts(spark, sf_dir))
    return rows.groupBy("workflow_id", "wave_id").agg(F.count("*").alias("n_rows"))


@query(
    "uniqueness_violations",
    with_(
        RECEIPTS_SQL,
        """select tenant_id, workflow_id, run_id, task_id, count(*) as copies
           from receipts group by all having count(*) > 1""",
    ),
)
def uniqueness_violations(spark, sf_dir):
    return receipts.uniqueness_violations(stored.receipts(spark, sf_dir), receipts.RECEIPT_KEY)


# --- tenants --------------------------------------------------------------


@query("tenant_scope", with_(ALERTS_SQL, "select tenant_id, alert_id from alerts where tenant_id = 't1'"))
def tenant_scope(spark, sf_dir):
    rows = tenancy.tenant_scope(stored.alerts(spark, sf_dir), "t1")
    return rows.select("tenant_id", "alert_id")


@query(
    "tenant_write_check",
    with_(ALERTS_SQL, "select tenant_id, alert_id from alerts where tenant_id <> 't1'"),
)
def tenant_write_check(spark, sf_dir):
    rows = tenancy.tenant_write_check(stored.alerts(spark, sf_dir), "t1")
    return rows.select("tenant_id", "alert_id")


@query(
    "immutable_columns",
    """select 'al_' || o_orderkey as alert_id,
              case when o_orderkey % 35 = 0 then 'aisle,mean_seconds'
                   when o_orderkey % 5 = 0 then 'aisle' else 'mean_seconds' end as changed
       from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0""",
)
def immutable_columns(spark, sf_dir):
    """The new table changes attempts everywhere, the aisle or mean of some rows."""
    old = stored.alerts(spark, sf_dir)
    k = F.substring_index("alert_id", "_", -1).cast("long")
    new = old.withColumns(
        {
            "attempts": F.col("attempts") + 1,
            "aisle": F.when(k % 5 == 0, "B99").otherwise(F.col("aisle")),
            "mean_seconds": F.when(k % 7 == 0, F.col("mean_seconds") + 1).otherwise(
                F.col("mean_seconds")
            ),
        }
    )
    rows = tenancy.immutable_columns(old, new, key=("alert_id",))
    return rows.select("alert_id", F.array_join("changed", ",").alias("changed"))
