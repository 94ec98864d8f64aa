"""Table queries: filter, order, limit, aggregate, predicates and changes.

These are plain DataFrame calls; no layer is put between the user and Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.operators import tables
from wavetrail.operators.ordered import global_positions
from wavetrail.plans import stored
from wavetrail.plans.movements import with_
from wavetrail.plans.registry import query, table
from wavetrail.plans.stored import ALERTS_SQL, NOW_TEXT, RECEIPTS_SQL


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _alerts_sql(select: str) -> str:
    return with_(ALERTS_SQL, select)


# --- reading --------------------------------------------------------------


@query(
    "q_where",
    """select event_id, user_id, value from events
       where event_type = 'click' and value > 20 and user_id % 2 = 0""",
)
def q_where(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("event_type = 'click'").filter("value > 20")
    return rows.filter("user_id % 2 = 0").select("event_id", "user_id", "value")


@query("q_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def q_limit(spark, sf_dir):
    ordered = _orders(spark, sf_dir).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return ordered.limit(25).select("o_orderkey", "o_totalprice")


@query("q_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey offset 40")
def q_offset(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.skip_rows(rows, ["o_totalprice", "o_orderkey"], 40, chunks)


@query(
    "q_limit_offset",
    "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25 offset 50",
)
def q_limit_offset(spark, sf_dir):
    ordered = _orders(spark, sf_dir).orderBy("o_totalprice", "o_orderkey")
    return ordered.offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("q_unique", "select distinct event_type, user_id from events")
def q_unique(spark, sf_dir):
    return _events(spark, sf_dir).select("event_type", "user_id").distinct()


def _ordered_sql(by: str) -> str:
    return _alerts_sql(f"select row_number() over (order by {by}, alert_id) as place, alert_id from alerts")


def _placed(rows: DataFrame, *by) -> DataFrame:
    """The place of every row in the whole order, from range chunks and their counts."""
    keys = {f"_k{i}": c for i, c in enumerate(by)}
    keyed = rows.select("alert_id", *[c.alias(k) for k, c in keys.items()])
    placed = global_positions(keyed, [*keys, "alert_id"], 32, "place")
    return placed.select(F.col("place").cast("long").alias("place"), "alert_id")


@query("q_order_asc", _ordered_sql("next_attempt_at asc nulls last"))
def q_order_asc(spark, sf_dir):
    """Nulls come last, as in the reference's database."""
    at = F.col("next_attempt_at")
    return _placed(stored.alerts(spark, sf_dir), at.isNull(), at)


@query("q_order_desc", _ordered_sql("next_attempt_at desc nulls first"))
def q_order_desc(spark, sf_dir):
    at = F.col("next_attempt_at")
    return _placed(stored.alerts(spark, sf_dir), at.isNotNull(), -F.unix_micros(at.cast("timestamp")))


@query(
    "q_first",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 1",
)
def q_first(spark, sf_dir):
    ordered = _orders(spark, sf_dir).orderBy("o_orderdate", "o_orderkey")
    return tables.require_first(ordered).select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_first_id", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 1")
def q_first_id(spark, sf_dir):
    ordered = _orders(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey")
    return tables.require_first(ordered.select("o_orderkey", "o_orderdate")).select("o_orderkey")


@query(
    "q_only",
    "select o_orderkey, o_custkey from orders where o_orderkey = (select max(o_orderkey) from orders)",
)
def q_only(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    last = orders.agg(F.max("o_orderkey").alias("o_orderkey"))
    return tables.require_one(orders.join(last, "o_orderkey")).select("o_orderkey", "o_custkey")


@query("q_only_id", "select max(o_orderkey) as o_orderkey from orders")
def q_only_id(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderkey")
    last = orders.agg(F.max("o_orderkey").alias("o_orderkey"))
    return tables.require_one(orders.join(last, "o_orderkey"))


@query("q_all", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def q_all(spark, sf_dir):
    return _orders(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("q_ids", "select event_id from events")
def q_ids(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id")


@query("q_count", "select count(*) as n from events where event_type = 'error'")
def q_count(spark, sf_dir):
    return _events(spark, sf_dir).filter("event_type = 'error'").agg(F.count("*").alias("n"))


@query("q_exist", "select exists(select 1 from events where event_type = 'error' and value > 200) as found")
def q_exist(spark, sf_dir):
    """Each task stops at its first hit, and one row decides."""
    hit = _events(spark, sf_dir).filter("event_type = 'error' and value > 200").limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


@query("q_select", "select o_custkey, o_orderstatus from orders where o_totalprice > 1000")
def q_select(spark, sf_dir):
    return _orders(spark, sf_dir).filter("o_totalprice > 1000").select("o_custkey", "o_orderstatus")


@query(
    "q_aggregate",
    """select count(*) as n, round(sum(value), 2) as total, min(value) as low, max(value) as high,
              round(avg(value), 6) as mean from events""",
)
def q_aggregate(spark, sf_dir):
    return _events(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@query(
    "q_group_by",
    """select user_id, event_type, count(*) as n, avg(event_id) as mean
       from events group by all order by n desc, user_id, event_type limit 50""",
)
def q_group_by(spark, sf_dir):
    grouped = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.avg("event_id").alias("mean")
    )
    return grouped.orderBy(F.desc("n"), "user_id", "event_type").limit(50)


AGGREGATES = {
    "agg_count": (lambda: F.count("*").alias("result"), "count(*)"),
    "agg_max": (lambda: F.max("o_totalprice").alias("result"), "max(o_totalprice)"),
    "agg_mean": (lambda: F.avg("o_orderkey").alias("result"), "avg(o_orderkey)"),
    "agg_min": (lambda: F.min("o_totalprice").alias("result"), "min(o_totalprice)"),
    "agg_sum": (lambda: F.sum("o_orderkey").alias("result"), "cast(sum(o_orderkey) as bigint)"),
}


def _aggregate_query(name, column, text) -> None:
    @query(name, f"select o_custkey, {text} as result from orders group by o_custkey")
    def aggregate(spark, sf_dir):
        return _orders(spark, sf_dir).groupBy("o_custkey").agg(column())


@query("agg_as", "select o_orderstatus as status, count(*) as order_count from orders group by 1")
def agg_as(spark, sf_dir):
    grouped = _orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("status"))
    return grouped.agg(F.count("*").alias("order_count"))


@query("q_get", "select o_orderkey, o_totalprice from orders where o_orderkey = 7")
def q_get(spark, sf_dir):
    return _orders(spark, sf_dir).filter("o_orderkey = 7").select("o_orderkey", "o_totalprice")


# --- predicates -----------------------------------------------------------

def _priority():
    return F.col("o_orderpriority")


# built lazily: a Column needs a running session
ORDER_PREDICATES = {
    "p_eq": (lambda: _priority() == "1-URGENT", "o_orderpriority = '1-URGENT'"),
    "p_in": (lambda: _priority().isin("1-URGENT", "5-LOW"), "o_orderpriority in ('1-URGENT', '5-LOW')"),
    "p_gt": (lambda: F.col("o_totalprice") > 250000, "o_totalprice > 250000"),
    "p_gte": (lambda: _priority() >= "3-MEDIUM", "o_orderpriority >= '3-MEDIUM'"),
    "p_lt": (lambda: _priority() < "3-MEDIUM", "o_orderpriority < '3-MEDIUM'"),
    "p_lte": (
        lambda: F.col("o_orderdate") <= F.expr("timestamp_ntz '1998-01-01 00:00:00'"),
        "o_orderdate <= timestamp '1998-01-01 00:00:00'",
    ),
    "p_contains": (lambda: _priority().contains("-U"), "contains(o_orderpriority, '-U')"),
    "p_has_prefix": (lambda: _priority().startswith("2"), "starts_with(o_orderpriority, '2')"),
    "p_has_suffix": (lambda: _priority().endswith("LOW"), "ends_with(o_orderpriority, 'LOW')"),
    "p_equal_fold": (lambda: F.lower(_priority()) == F.lower(F.lit("5-Low")), "lower(o_orderpriority) = lower('5-Low')"),
    "p_contains_fold": (
        lambda: F.lower(_priority()).contains("urg"), "contains(lower(o_orderpriority), lower('URG'))"
    ),
    "p_and": (
        lambda: (_priority() == "1-URGENT") & (F.col("o_orderstatus") == "F"),
        "o_orderpriority = '1-URGENT' and o_orderstatus = 'F'",
    ),
    "p_or": (
        lambda: (_priority() == "1-URGENT") | (F.col("o_orderstatus") == "F"),
        "o_orderpriority = '1-URGENT' or o_orderstatus = 'F'",
    ),
}
DUE = "timestamp '2000-01-01 00:00:00'"
# on a nullable column: a comparison with null, and its negation, keep no row
ALERT_PREDICATES = {
    "p_neq": (lambda: F.col("next_attempt_at") != F.expr(DUE), f"next_attempt_at <> {DUE}"),
    "p_not_in": (
        lambda: ~F.col("next_attempt_at").isin(F.expr(DUE), F.lit(None)) | (F.col("attempts") == 3),
        f"next_attempt_at not in ({DUE}, null) or attempts = 3",
    ),
    "p_not": (lambda: ~(F.col("next_attempt_at") > F.expr(DUE)), f"not (next_attempt_at > {DUE})"),
    "p_is_nil": (lambda: F.col("delivered_at").isNull(), "delivered_at is null"),
    "p_not_nil": (lambda: F.col("next_attempt_at").isNotNull(), "next_attempt_at is not null"),
}


def _predicate_query(name, rows, key, predicate, sql) -> None:
    @query(name, sql)
    def filtered(spark, sf_dir):
        return rows(spark, sf_dir).filter(predicate()).select(key)


for _name, (_column, _text) in AGGREGATES.items():
    _aggregate_query(_name, _column, _text)
for _name, (_column, _text) in ORDER_PREDICATES.items():
    _predicate_query(_name, _orders, "o_orderkey", _column, f"select o_orderkey from orders where {_text}")
for _name, (_column, _text) in ALERT_PREDICATES.items():
    _predicate_query(
        _name, stored.alerts, "alert_id", _column, _alerts_sql(f"select alert_id from alerts where {_text}")
    )


# --- changes --------------------------------------------------------------


def _new_alerts(spark, sf_dir) -> DataFrame:
    """Rows to insert: no id, no creation time, no defaults."""
    return stored.alerts(spark, sf_dir).select(
        "tenant_id", F.concat(F.lit("new_"), "alert_id").alias("alert_id"), "site_id", "aisle",
        "workflow_id", "run_id", "mean_seconds", "threshold_seconds",
    )


CREATED_SQL = f"""select tenant_id, 'new_' || alert_id as alert_id, mean_seconds, '' as last_error,
       0::bigint as attempts, false as dead, '{NOW_TEXT}' as created_at from alerts"""


def _created(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tenant_id", "alert_id", "mean_seconds", "last_error", "attempts", "dead",
        F.col("created_at").cast("timestamp_ntz").cast("string").alias("created_at"),
    )


@query("dml_create", _alerts_sql(CREATED_SQL))
def dml_create(spark, sf_dir):
    return _created(tables.with_defaults(_new_alerts(spark, sf_dir), "alerts", stored.now()))


@query(
    "dml_create_bulk",
    _alerts_sql(
        f"""select tenant_id, alert_id from alerts
            union all select tenant_id, 'new_' || alert_id from alerts"""
    ),
)
def dml_create_bulk(spark, sf_dir):
    old = tables.with_defaults(stored.alerts(spark, sf_dir), "alerts", stored.now())
    added = tables.create_bulk(old, _new_alerts(spark, sf_dir), "alerts", stored.now())
    return added.select("tenant_id", "alert_id")


@query(
    "dml_map_create_bulk",
    """select 't' || user_id % 3 as tenant_id, 'ev_' || event_id as event_id, value as seconds
       from events where value > 0""",
)
def dml_map_create_bulk(spark, sf_dir):
    """Each event is mapped to an observation and inserted."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    user, event = F.col("user_id"), F.col("event_id")
    rows = _events(spark, sf_dir).filter("value > 0").select(
        text("t", user % 3).alias("tenant_id"), text("ev_", event).alias("event_id"),
        F.lit("s0").alias("site_id"), F.lit("A01").alias("aisle"), text("w", user).alias("workflow_id"),
        F.lit("r0").alias("run_id"), text("task_", event).alias("task_id"),
        F.col("value").alias("seconds"), F.col("ts").alias("observed_at"),
    )
    filled = tables.with_defaults(rows, "observations", stored.now())
    added = tables.create_bulk(filled.limit(0), rows, "observations", stored.now())
    return added.select("tenant_id", "event_id", "seconds")


CHANGED = "tenant_id, alert_id, aisle, last_error, attempts, coalesce(cast(delivered_at as varchar), '') as delivered_at"


def _changed(rows: DataFrame) -> DataFrame:
    delivered = F.coalesce(F.col("delivered_at").cast("string"), F.lit(""))
    return rows.select(
        "tenant_id", "alert_id", "aisle", "last_error", "attempts", delivered.alias("delivered_at")
    )


@query(
    "dml_update",
    _alerts_sql(
        f"""select {CHANGED} from (
              select * replace (case when next_attempt_at < timestamp '{NOW_TEXT}' then 'late'
                                else last_error end as last_error) from alerts)"""
    ),
)
def dml_update(spark, sf_dir):
    """Rows without a next attempt do not match: unknown is no match."""
    late = F.col("next_attempt_at") < stored.now()
    rows = stored.alerts(spark, sf_dir)
    return _changed(tables.update_where(rows, late, {"last_error": F.lit("late")}))


@query(
    "dml_update_count",
    _alerts_sql(f"select count(*) as affected from alerts where next_attempt_at < timestamp '{NOW_TEXT}'"),
)
def dml_update_count(spark, sf_dir):
    late = tables.matches(F.col("next_attempt_at") < stored.now())
    return stored.alerts(spark, sf_dir).agg(F.count_if(late).alias("affected"))


@query(
    "dml_add",
    _alerts_sql(
        f"""select {CHANGED} from (
              select * replace (case when tenant_id = 't1' then attempts + 3 else attempts end as attempts)
              from alerts)"""
    ),
)
def dml_add(spark, sf_dir):
    changes = {"attempts": F.col("attempts") + 3}
    rows = tables.update_where(stored.alerts(spark, sf_dir), F.col("tenant_id") == "t1", changes)
    return _changed(rows)


@query(
    "dml_clear",
    _alerts_sql(
        f"""select {CHANGED} from (
              select * replace (case when tenant_id = 't1' then null else delivered_at end as delivered_at)
              from alerts)"""
    ),
)
def dml_clear(spark, sf_dir):
    changes = {"delivered_at": None}
    rows = tables.update_where(stored.alerts(spark, sf_dir), F.col("tenant_id") == "t1", changes)
    return _changed(rows)


LAST_ALERT = "'al_' || (select max(o_orderkey) from orders)"


def _last_alert(spark, sf_dir) -> str:
    return f"al_{_orders(spark, sf_dir).agg(F.max('o_orderkey')).first()[0]}"


@query(
    "dml_update_one",
    _alerts_sql(
        f"""select {CHANGED} from (
              select * replace (case when alert_id = {LAST_ALERT} then 'seen' else last_error end
                                as last_error) from alerts)"""
    ),
)
def dml_update_one(spark, sf_dir):
    key = F.col("alert_id") == _last_alert(spark, sf_dir)
    rows = tables.update_one(stored.alerts(spark, sf_dir), key, {"last_error": F.lit("seen")})
    return _changed(rows)


@query(
    "dml_delete",
    _alerts_sql(
        f"""select alert_id from alerts
            where not coalesce(next_attempt_at < timestamp '{NOW_TEXT}', false)"""
    ),
)
def dml_delete(spark, sf_dir):
    late = F.col("next_attempt_at") < stored.now()
    return tables.delete_where(stored.alerts(spark, sf_dir), late).select("alert_id")


@query("dml_delete_one", _alerts_sql(f"select alert_id from alerts where alert_id <> {LAST_ALERT}"))
def dml_delete_one(spark, sf_dir):
    key = F.col("alert_id") == _last_alert(spark, sf_dir)
    return tables.delete_one(stored.alerts(spark, sf_dir), key).select("alert_id")


@query(
    "dml_validators",
    with_(
        RECEIPTS_SQL,
        """select workflow_id, task_id,
                  case when l_suppkey % 5 = 0 then 'tenant_id is empty'
                       when l_suppkey % 7 = 0 then 'aisle is missing'
                       when task_id = 'pick_99' then 'task_id is not in the catalog' end as violation,
                  count(*) as n_rows
           from receipts where l_suppkey % 5 = 0 or l_suppkey % 7 = 0 or task_id = 'pick_99'
           group by all""",
    ),
)
def dml_validators(spark, sf_dir):
    supp = F.col("l_suppkey")
    rows = stored.receipts(spark, sf_dir).withColumns(
        {
            "tenant_id": F.when(supp % 5 == 0, "").otherwise(F.col("tenant_id")),
            "aisle": F.when(supp % 7 != 0, F.col("aisle")),
        }
    )
    filled = tables.with_defaults(rows, "process_tasks", stored.now())
    bad = tables.row_violations(filled, "process_tasks", stored.task_ids(spark))
    return bad.groupBy("workflow_id", "task_id", "violation").agg(F.count("*").alias("n_rows"))


@query(
    "dml_validators_observation",
    """select event_id, case when event_id % 11 = 3 then 'tenant_id is empty'
              when value > 50 then 'seconds is not positive' end as violation
       from events where event_id % 11 = 3 or value > 50""",
)
def dml_validators_observation(spark, sf_dir):
    """Seconds above 50 are negated, so that the positive check has work to do."""
    event = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        F.when(event % 11 == 3, "").otherwise("t").alias("tenant_id"),
        event.cast("string").alias("event_id"), F.lit("s").alias("site_id"), F.lit("a").alias("aisle"),
        F.lit("w").alias("workflow_id"), F.lit("r").alias("run_id"), F.lit("k").alias("task_id"),
        F.when(F.col("value") > 50, -F.col("value")).otherwise(F.greatest("value", F.lit(1.0))).alias(
            "seconds"
        ),
        F.col("ts").alias("observed_at"),
    )
    bad = tables.row_violations(
        tables.with_defaults(rows, "observations", stored.now()), "observations"
    )
    return bad.select(F.col("event_id").cast("long").alias("event_id"), "violation")
