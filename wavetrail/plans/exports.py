"""Nested exports derived from `events`, and the flat SQL view of their spans.

An export holds about a hundred spans of one tenant in two resource groups
(one per site). Some spans break one rule each, some exports have a wrong or a
second api key, and some are inflated beyond the span limit with other spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.functions.identity import workflow_id
from wavetrail.plans.movements import baselines
from wavetrail.plans.registry import table

ORIGIN = "2024-01-01 00:00:00"


def tokens(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """select 'token-for-t' || n || '-0001' as token, 't' || n as tenant_id
           from values (0), (1), (2) as numbers(n)"""
    )


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports in the landed schema."""
    e, group = F.col("event_id"), F.col("grp")
    text = lambda c: c.cast("string")
    tenant = F.concat(F.lit("t"), text(F.col("user_id") % 3))
    wave = F.concat(F.lit("w"), text(F.col("user_id")))
    base = table(spark, sf_dir, "events").withColumn("grp", F.floor(e / 300).cast("long"))
    # a second copy for each tenth event; fifteen fillers per event of an inflated group
    reps = F.when(group % 17 == 7, F.sequence(F.lit(0), F.lit(15))).when(
        e % 10 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    base = base.withColumn("rep", F.explode(reps))
    received = F.expr(f"timestamp_ntz '{ORIGIN}'") + F.expr("interval 10 minutes") * group.cast("int")
    received = received.cast("timestamp")
    received_micros = F.unix_micros(received)
    offset_minutes = F.when(e % 50 == 7, 2).when(e % 41 == 3, -6).otherwise(-(e % 5))
    end = (received_micros + offset_minutes * 60_000_000) * 1000
    took = F.round(F.col("value") * 100).cast("long") * 10_000_000
    took = F.when(e % 67 == 9, -took).when(e % 61 == 10, took + 3_600_000_000_000).otherwise(took)

    def entry(key: str, value, arm: str = "string_value"):
        arms = {"string_value": "string", "bool_value": "boolean", "int_value": "bigint",
                "double_value": "double", "bytes_value": "binary"}
        fields = [
            (value if a == arm else F.lit(None)).cast(t).alias(a) for a, t in arms.items()
        ]
        return F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))

    task = F.when(e % 97 == 5, "bad task").otherwise(F.concat(F.lit("task_"), text(e)))
    site = entry("warehouse.site", F.concat(F.lit("s"), text(F.col("user_id") % 2)))
    aisle_text = F.concat(F.lit("A"), F.lpad(text(e % 2 + 1), 2, "0"))
    aisle = F.when(e % 83 == 4, entry("warehouse.aisle", F.lit(True), "bool_value")).otherwise(
        entry("warehouse.aisle", aisle_text)
    )
    flow = F.when(e % 73 == 7, "picking/other").otherwise(workflow_id(tenant, wave))
    run = F.when(e % 71 == 8, "r 1").otherwise(F.concat(F.lit("r"), text(F.col("user_id") % 4)))
    common = F.array(
        entry("tenant.id", F.when(e % 79 == 6, "other").otherwise(tenant)),
        site,
        aisle,
        entry("warehouse.task", task),
        entry("warehouse.wave", wave),
        entry("temporal.workflow_id", flow),
        entry("temporal.run_id", run),
        entry("demo.synthetic", F.lit(True), "bool_value"),
    )
    attributes = F.when(e % 89 == 3, F.concat(common, F.array(site))).otherwise(common)
    # a copy is a retry: same logical movement, other trace id
    digest = F.md5(F.concat(text(e), F.lit("/"), text(F.col("rep"))))
    trace = F.when(e % 59 == 11, F.unhex(F.lit("00" * 16))).otherwise(F.unhex(digest))
    span = F.struct(
        F.when((F.col("rep") >= 2) | (e % 53 == 12), "http.request")
        .otherwise("warehouse.movement")
        .alias("name"),
        trace.alias("trace_id"),
        F.unhex(F.substring(digest, 1, 16)).alias("span_id"),
        (end - took).cast("decimal(20,0)").alias("start_unix_nano"),
        end.cast("decimal(20,0)").alias("end_unix_nano"),
        F.when(
            F.col("event_type") == "error", F.struct(F.lit(2).alias("code"))
        ).alias("status"),
        attributes.alias("attributes"),
    )
    rows = base.select(
        group, tenant.alias("tenant"), (F.col("user_id") % 2).alias("rs"),
        F.struct(e, F.col("rep"), span.alias("span")).alias("item"), received.alias("received_at"),
    )
    side = lambda n: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("rs") == n, F.col("item")))), lambda x: x["span"]
    )
    # at most 300 events and sixteen copies of each meet in one export
    grouped = rows.groupBy("grp", "tenant").agg(
        F.first("received_at").alias("received_at"), side(0).alias("even"), side(1).alias("odd")
    )
    token = F.concat(F.lit("token-for-"), F.col("tenant"), F.lit("-0001"))
    scope = lambda spans: F.struct(
        F.array(F.struct(F.col(spans).alias("spans"))).alias("scope_spans")
    )
    return grouped.select(
        F.concat(F.lit("x"), text(group), F.lit("-"), "tenant").alias("export_id"),
        F.when(group % 11 == 3, F.array(token, token))
        .when(group % 13 == 5, F.array(F.lit("token-unknown-0001")))
        .otherwise(F.array(token))
        .alias("api_keys"),
        "received_at",
        F.array(scope("even"), scope("odd")).alias("resource_spans"),
    )


# Flat view: one row per span with the fields a decoder would see.
SPANS_SQL = f"""
raw as (
  select e.*, event_id // 300 as grp, r.rep
  from events e join (select unnest(range(16)) as rep) r
    on r.rep = 0 or (event_id // 300) % 17 = 7 or (r.rep = 1 and event_id % 10 = 0)
),
spans as (
  select event_id as seq, rep, grp, 't' || user_id % 3 as tenant_id,
    'x' || grp || '-t' || user_id % 3 as export_id, user_id % 2 as rs_pos, 0 as ss_pos,
    row_number() over (partition by grp, user_id % 3, user_id % 2 order by event_id, rep) - 1 as sp_pos,
    count(*) over (partition by grp, user_id % 3) as export_spans,
    case when grp % 11 = 3 then 2 else 1 end as n_keys,
    grp % 13 = 5 and grp % 11 <> 3 as unknown_key,
    rep < 2 and event_id % 53 <> 12 as is_movement,
    case when event_id % 79 = 6 then 'other' else 't' || user_id % 3 end as tenant_attr,
    's' || user_id % 2 as site_id, 'A0' || (event_id % 2 + 1) as aisle,
    case when event_id % 97 = 5 then 'bad task' else 'task_' || event_id end as task_id,
    'w' || user_id as wave_id,
    case when event_id % 73 = 7 then 'picking/other'
         else 'picking/t' || user_id % 3 || '/w' || user_id end as workflow_id,
    case when event_id % 71 = 8 then 'r 1' else 'r' || user_id % 4 end as run_id,
    event_id % 89 = 3 as has_duplicate, event_id % 83 = 4 as has_bool, event_id % 59 = 11 as zero_trace,
    event_type = 'error' as failed,
    case when event_id % 50 = 7 then 120 when event_id % 41 = 3 then -360
         else -60 * (event_id % 5) end as end_offset,
    case when event_id % 67 = 9 then -round(value * 100) / 100.0
         when event_id % 61 = 10 then round(value * 100) / 100.0 + 3600
         else round(value * 100) / 100.0 end as took,
    timestamp '{ORIGIN}' + grp * interval '10' minute as received_at
  from raw
),
looked_at as (
  select * from spans where n_keys = 1 and not unknown_key and export_spans <= 1000 and is_movement
),
decoded as (
  select *, case
      when has_duplicate then 'duplicate_attribute'
      when has_bool then 'non_string_attribute'
      when tenant_attr <> tenant_id then 'tenant_mismatch'
      when not regexp_matches(task_id, '^[A-Za-z0-9_-]{{1,64}}$') then 'invalid_id'
      when workflow_id <> 'picking/' || tenant_id || '/' || wave_id then 'workflow_mismatch'
      when not regexp_matches(run_id, '^[A-Za-z0-9_-]{{1,64}}$') then 'invalid_run_id'
      when failed then 'failed_span'
      when took <= 0 or took > 3600 then 'invalid_duration'
      when end_offset > 60 or end_offset < -300 then 'stale_or_future'
      when zero_trace then 'invalid_trace_ids'
    end as reject_reason
  from looked_at
)
"""

__all__ = ["SPANS_SQL", "baselines", "exports", "tokens"]
