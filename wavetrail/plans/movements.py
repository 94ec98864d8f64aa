"""Movement observations derived from `events`, as a DataFrame and as SQL.

A tenth of the rows is delivered twice, arrivals are delayed by 0-7 minutes,
some rows are dated ahead, some ids are bad and error events are failed spans.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.functions.identity import event_id, workflow_id
from wavetrail.operators.detector import DetectorConfig
from wavetrail.plans.registry import table

ARRIVAL = ("received_at", "seq", "redelivery")
CONFIG = DetectorConfig(
    window=3,
    sigma=2.5,
    cooldown=timedelta(days=1),
    idle_ttl=timedelta(days=2),
    arrival=ARRIVAL,
)


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.expr("interval 1 minute")
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    part = lambda prefix, col: F.concat(F.lit(prefix), col.cast("string"))
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.explode(copies).alias("redelivery")
    )
    delay = (F.col("event_id") % 7 + F.col("redelivery")).cast("int")
    return (
        events.select(
            F.col("event_id").alias("seq"),
            "redelivery",
            part("t", F.col("user_id") % 3).alias("tenant_id"),
            part("s", F.col("user_id") % 2).alias("site_id"),
            F.concat(
                F.lit("A"), F.lpad((F.col("event_id") % 2 + 1).cast("string"), 2, "0")
            ).alias("aisle"),
            part("w", F.col("user_id")).alias("wave_id"),
            part("r", F.col("user_id") % 4).alias("run_id"),
            F.when(F.col("event_id") % 97 == 5, "bad task")
            .otherwise(part("task_", F.col("event_id")))
            .alias("task_id"),
            F.col("value").alias("seconds"),
            F.col("ts").alias("observed_at"),
            F.when(F.col("event_id") % 50 == 7, F.col("ts") - F.expr("interval 2 minutes"))
            .otherwise(F.col("ts") + minute * delay)
            .alias("received_at"),
            F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status_code"),
        )
        .withColumn("workflow_id", workflow_id("tenant_id", "wave_id"))
        .withColumn("event_id", event_id("tenant_id", "workflow_id", "run_id", "task_id"))
    )


def completed_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements whose span did not fail: what the detector is given."""
    return movements(spark, sf_dir).filter("status_code != 2")


def baselines(spark: SparkSession) -> DataFrame:
    """Eleven of the twelve (tenant, site, aisle) keys; mean 30, stddev 16."""
    return spark.sql(
        """
        select 't' || t as tenant_id, 's' || s as site_id, 'A0' || a as aisle,
               cast(30 as double) as mean, cast(16 as double) as stddev
        from (select explode(array(0, 1, 2)) as t)
        lateral view explode(array(0, 1)) sites as s
        lateral view explode(array(1, 2)) aisles as a
        where not (t = 2 and s = 1 and a = 2)
        """
    )


# The same derivations for the SQL side. CTEs are joined with `with_`.
MOVEMENTS_SQL = """
movements as (
  select *, sha256(concat(strlen(tenant_id), ':', tenant_id, strlen(workflow_id), ':', workflow_id,
                          strlen(run_id), ':', run_id, strlen(task_id), ':', task_id)) as event_id
  from (
    select event_id as seq, d.redelivery,
      't' || cast(user_id % 3 as varchar) as tenant_id,
      's' || cast(user_id % 2 as varchar) as site_id,
      'A' || lpad(cast(event_id % 2 + 1 as varchar), 2, '0') as aisle,
      'w' || cast(user_id as varchar) as wave_id,
      'picking/t' || cast(user_id % 3 as varchar) || '/w' || cast(user_id as varchar) as workflow_id,
      'r' || cast(user_id % 4 as varchar) as run_id,
      case when event_id % 97 = 5 then 'bad task'
           else 'task_' || cast(event_id as varchar) end as task_id,
      value as seconds, ts as observed_at,
      case when event_id % 50 = 7 then ts - interval '2' minute
           else ts + (event_id % 7 + d.redelivery) * interval '1' minute end as received_at,
      case when event_type = 'error' then 2 else 1 end as status_code
    from events join (select 0 as redelivery union all select 1) d
      on d.redelivery = 0 or event_id % 10 = 0
  )
),
completed as (select * from movements where status_code <> 2)
"""

BASELINES_SQL = """
baselines as (
  select 't' || t as tenant_id, 's' || s as site_id, 'A0' || a as aisle,
         30.0::double as mean, 16.0::double as stddev
  from (values (0), (1), (2)) tenants(t), (values (0), (1)) sites(s), (values (1), (2)) aisles(a)
  where not (t = 2 and s = 1 and a = 2)
)
"""

# gate, baseline, dedup, sessions, rolling mean, cooldown: written from the rules
DETECTOR_SQL = (
    MOVEMENTS_SQL
    + ","
    + BASELINES_SQL
    + """,
gated as (
  select *, case
      when not (regexp_matches(tenant_id, '^[A-Za-z0-9_-]{1,64}$')
            and regexp_matches(site_id, '^[A-Za-z0-9_-]{1,64}$')
            and regexp_matches(aisle, '^[A-Za-z0-9_-]{1,64}$')
            and regexp_matches(task_id, '^[A-Za-z0-9_-]{1,64}$')
            and event_id <> '' and run_id <> '') then 'invalid_id'
      when isnan(seconds) or seconds <= 0 or seconds > 3600 then 'invalid_duration'
      when observed_at > received_at + interval '1' minute
        or observed_at < received_at - interval '5' minute then 'stale_or_future'
    end as reject_reason
  from completed
),
valid as (
  select g.*, b.mean, b.stddev, b.mean + 2.5 * b.stddev as threshold
  from gated g join baselines b using (tenant_id, site_id, aisle)
  where reject_reason is null
),
committed as (
  select * from (
    select *, row_number() over (partition by tenant_id, event_id
                                 order by received_at, seq, redelivery) as rn
    from valid
  ) where rn = 1
),
gaps as (
  select *, lag(received_at) over w as prev_at,
         row_number() over w as pos
  from committed
  window w as (partition by tenant_id, site_id, aisle, workflow_id, run_id
               order by received_at, seq, redelivery)
),
opened as (
  select *, (prev_at is null or received_at - prev_at > interval '2' day) as opens from gaps
),
sessions as (
  select *, max(case when opens then received_at end) over (
      partition by tenant_id, site_id, aisle, workflow_id, run_id
      order by received_at, seq, redelivery rows unbounded preceding) as session_start
  from opened
),
rolled as (
  select *, case when n_seen >= 3 then (s2 + s1 + seconds) / 3 end as mean_seconds
  from (
    select *, row_number() over w as n_seen, lag(seconds, 1) over w as s1,
           lag(seconds, 2) over w as s2
    from sessions
    window w as (partition by tenant_id, site_id, aisle, workflow_id, run_id, session_start
                 order by received_at, seq, redelivery)
  )
),
breached as (
  select * from rolled where n_seen >= 3 and mean_seconds >= threshold
),
ranked as (
  select *, row_number() over (
      partition by tenant_id, site_id, aisle, workflow_id, run_id, session_start
      order by received_at, seq, redelivery) as b_no
  from breached
),
cooled as (
  select *, true as fires, received_at as last_fired from ranked where b_no = 1
  union all
  select r.*, r.received_at - c.last_fired >= interval '1' day,
         case when r.received_at - c.last_fired >= interval '1' day
              then r.received_at else c.last_fired end
  from cooled c join ranked r
    on r.tenant_id = c.tenant_id and r.site_id = c.site_id and r.aisle = c.aisle
   and r.workflow_id = c.workflow_id and r.run_id = c.run_id
   and r.session_start = c.session_start and r.b_no = c.b_no + 1
),
alerts as (
  select sha256(concat(strlen(tenant_id), ':', tenant_id, strlen(event_id), ':', event_id,
                       '13:congestion-v1')) as alert_id,
         tenant_id, site_id, aisle, workflow_id, run_id, event_id,
         mean_seconds, threshold as threshold_seconds, received_at as fired_at
  from cooled where fires
)
"""
)


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes}\n{select}"
