"""Stored tables derived from `orders` and `lineitem`, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.plans.registry import table

NOW_TEXT = "2000-01-01 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz '{NOW_TEXT}'")


def _text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    tenant = _text("t", F.col("o_custkey") % 3)
    return orders.select(
        tenant.alias("tenant_id"),
        F.col("o_orderdate").alias("created_at"),
        _text("al_", k).alias("alert_id"),
        _text("s", k % 2).alias("site_id"),
        _text("A0", k % 2 + 1).alias("aisle"),
        F.concat(F.lit("picking/"), tenant, F.lit("/w"), k.cast("string")).alias("workflow_id"),
        F.lit("r0").alias("run_id"),
        F.col("o_totalprice").alias("mean_seconds"),
        F.lit(70.0).alias("threshold_seconds"),
        F.when(
            F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 1 day")
        ).alias("delivered_at"),
        F.when(k % 9 > 0, "timeout").otherwise("").alias("last_error"),
        (k % 9).alias("attempts"),
        F.when(
            k % 9 > 0, now() + F.expr("interval 1 hour") * (k % 5 - 2).cast("int")
        ).alias("next_attempt_at"),
        (k % 9 >= 8).alias("dead"),
    )


def tokens(spark: SparkSession) -> DataFrame:
    """Tenants t0 and t1 hold tokens, t2 does not."""
    return spark.sql(
        """select 'token-for-t' || n || '-0001' as token, 't' || n as tenant_id
           from values (0), (1) as numbers(n)"""
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal outcomes: each fourth fails; each 29th names an alert that does not exist."""
    k = F.col("o_orderkey")
    error = (
        F.when(k % 12 == 0, F.repeat(F.lit("e"), 3000))
        .when(k % 12 == 4, F.repeat(F.lit("é"), 1500))
        .otherwise(F.concat(F.lit("x"), F.repeat(F.lit("é"), 1500)))
    )
    return table(spark, sf_dir, "orders").select(
        _text("t", F.col("o_custkey") % 3).alias("tenant_id"),
        F.when(k % 29 == 1, _text("gone_", k)).otherwise(_text("al_", k)).alias("alert_id"),
        (k % 4 != 0).alias("ok"),
        F.when(k % 4 == 0, error).otherwise("").alias("error"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts: one per order line."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return lines.select(
        _text("t", F.col("o_custkey") % 3).alias("tenant_id"),
        _text("al_", F.col("l_orderkey")).alias("alert_id"),
        (F.col("l_shipdate") + F.expr("interval 1 minute") * F.col("l_linenumber")).alias("at"),
        ((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 2 == 0)).alias("ok"),
        _text("E", F.col("l_partkey")).alias("error"),
    )


RECEIPT_ARRIVAL = ("l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts: one per order line; repeated (order, line) pairs are retries."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    tenant = _text("t", order % 3)
    return table(spark, sf_dir, "lineitem").select(
        tenant.alias("tenant_id"),
        _text("s", F.col("l_suppkey") % 2).alias("site_id"),
        F.when(order % 31 == 4, "bad wave").otherwise(_text("w", order)).alias("wave_id"),
        F.when(order % 23 == 6, F.concat(F.lit("picking/other/w"), order.cast("string")))
        .otherwise(F.concat(F.lit("picking/"), tenant, F.lit("/w"), order.cast("string")))
        .alias("workflow_id"),
        F.lit("r0").alias("run_id"),
        F.when(line == 7, "pick_99").otherwise(_text("pick_0", line)).alias("task_id"),
        _text("A0", F.col("l_suppkey") % 2 + 1).alias("aisle"),
        *RECEIPT_ARRIVAL,
    )


def task_ids(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "select concat('pick_0', n) as task_id from values (1),(2),(3),(4),(5),(6) as numbers(n)"
    )


ALERTS_SQL = f"""
alerts as (
  select 't' || o_custkey % 3 as tenant_id, o_orderdate as created_at,
    'al_' || o_orderkey as alert_id, 's' || o_orderkey % 2 as site_id,
    'A0' || (o_orderkey % 2 + 1) as aisle,
    'picking/t' || o_custkey % 3 || '/w' || o_orderkey as workflow_id, 'r0' as run_id,
    o_totalprice as mean_seconds, 70.0::double as threshold_seconds,
    case when o_orderstatus = 'F' then o_orderdate + interval '1' day end as delivered_at,
    case when o_orderkey % 9 > 0 then 'timeout' else '' end as last_error,
    o_orderkey % 9 as attempts, o_orderkey % 9 >= 8 as dead,
    case when o_orderkey % 9 > 0 then timestamp '{NOW_TEXT}'
         + (o_orderkey % 5 - 2) * interval '1' hour end as next_attempt_at
  from orders
)
"""
OUTBOX_SQL = (
    ALERTS_SQL
    + f""",
outcomes as (
  select 't' || o_custkey % 3 as tenant_id,
    case when o_orderkey % 29 = 1 then 'gone_' else 'al_' end || o_orderkey as alert_id,
    o_orderkey % 4 <> 0 as ok,
    case when o_orderkey % 4 <> 0 then '' when o_orderkey % 12 = 0 then repeat('e', 3000)
         when o_orderkey % 12 = 4 then repeat('é', 1500) else 'x' || repeat('é', 1500) end as error
  from orders
),
pending as (
  select * from alerts where delivered_at is null and not dead
    and (next_attempt_at is null or next_attempt_at <= timestamp '{NOW_TEXT}')
),
chosen as (
  select * from (
    select *, row_number() over (partition by tenant_id order by created_at, alert_id) as rn
    from pending where tenant_id in ('t0', 't1')
  ) where rn <= 100
),
tried as (
  select c.tenant_id, c.alert_id, o.ok, o.error,
         case when strlen(o.error) <= 2000 then o.error
              when o.error like 'e%' then left(o.error, 2000) else left(o.error, 1000) end as cut_error
  from chosen c join outcomes o using (tenant_id, alert_id)
)
"""
)
RECEIPTS_SQL = """
receipts as (
  select 't' || l_orderkey % 3 as tenant_id, 's' || l_suppkey % 2 as site_id,
    case when l_orderkey % 31 = 4 then 'bad wave' else 'w' || l_orderkey end as wave_id,
    case when l_orderkey % 23 = 6 then 'picking/other/w' || l_orderkey
         else 'picking/t' || l_orderkey % 3 || '/w' || l_orderkey end as workflow_id,
    'r0' as run_id,
    case when l_linenumber = 7 then 'pick_99' else 'pick_0' || l_linenumber end as task_id,
    'A0' || (l_suppkey % 2 + 1) as aisle,
    l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice
  from lineitem
)
"""
