"""Process models, waves and signals derived from `orders` and `lineitem`.

One model per order: start, some picks, a gateway, two packs, end. The order key
decides which single defect, if any, a model has; a few models are long chains
just within or beyond the node limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.operators import routes
from wavetrail.plans.registry import table

K = "o_orderkey"
ORDERS_PER_TASK = 200_000


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def shape(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Per order: key, defect number, number of picks and of extra chain tasks."""
    k = F.col(K)
    orders = table(spark, sf_dir, "orders").select(k)
    return (_spread(orders) if spread else orders).select(
        k,
        (k % 41).cast("int").alias("d"),
        (k % 5 + 1).cast("int").alias("n"),
        F.when(k % 1009 == 17, 500).when(k % 1009 == 18, 100).otherwise(0).alias("extra"),
        F.when(k % 41 == 13, text("p ", k)).otherwise(text("p", k)).alias("process_id"),
    )


def _spread(keys: DataFrame) -> DataFrame:
    """Order keys in tasks of about `ORDERS_PER_TASK`, before anything is made of them.

    An order becomes some twenty wide rows. What a task combines of them is held in its memory, so the
    number of tasks has to grow with the orders and not with the bytes of their file.
    """
    return keys.repartition(tasks_of(keys, ORDERS_PER_TASK))


def tasks_of(rows: DataFrame, per_task: int) -> int:
    """Number of tasks of at most about `per_task` rows; each core gets one at least."""
    return max(-(-rows.count() // per_task), rows.sparkSession.sparkContext.defaultParallelism)


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir)
    first = rows.select(
        text("doc", F.col(K)).alias("doc_id"),
        "process_id",
        F.when(F.col("d") == 17, "false").otherwise("true").alias("is_executable"),
        F.when(F.col("d") == 20, 1048577).otherwise(4000).cast("long").alias("n_bytes"),
    )
    second = rows.filter("d = 19").select(
        text("doc", F.col(K)).alias("doc_id"),
        text("q", F.col(K)).alias("process_id"),
        F.lit("true").alias("is_executable"),
        F.lit(4000).cast("long").alias("n_bytes"),
    )
    return first.unionByName(second)


def _node(id_: Column, kind: str | Column, aisle="", alternative="", variable="") -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        lit(id_).alias("id"), lit(kind).alias("kind"), lit(aisle).alias("aisle"),
        lit(alternative).alias("alternative"), lit(variable).alias("variable"),
    )


def _flow(id_, source, target, value="") -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        lit(id_).alias("id"), lit(source).alias("source"), lit(target).alias("target"),
        lit(value).alias("value"),
    )


def _elements(rows: DataFrame, fixed: Column) -> DataFrame:
    """One row per element: pick `i`, task `c` of the chain, or fixed element `j`, each from 1.

    Plain columns after one generator, so that a reader computes only the columns it uses.
    """
    picks, i = F.greatest("n", F.lit(0)), F.col("_i")
    numbered = rows.withColumn("_n", picks).withColumn("_i", F.explode(F.sequence(F.lit(1), picks + F.col("extra") + fixed)))
    return numbered.withColumns({"i": i, "c": i - F.col("_n"), "j": i - F.col("_n") - F.col("extra")})


def _by_place(pick, chain, *fixed) -> Column:
    """The value of an element by its place; a string is a literal."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    value = F.when(F.col("i") <= F.col("_n"), lit(pick)).when(F.col("j") <= 0, lit(chain))
    for j, one in enumerate(fixed, 1):
        value = value.when(F.col("j") == j, lit(one))
    return value.otherwise("")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, spread=True)
    k, d = F.col(K), F.col("d")
    more = F.when(d == 16, 7).when(d.isin(1, 9, 12), 6).otherwise(5)
    i, j = F.col("i"), F.col("j")
    aisle = text("A0", (k + i) % 3 + 1)
    alternative = F.when((k + i) % 4 == 0, "").otherwise(text("B0", (k + i) % 3 + 1))
    first_pick = i == 1
    task, seventh = "serviceTask", F.when(d == 16, "A01").otherwise("")
    listed = _elements(rows, more).filter(
        ((d != 15) | j.isin(1, 5)) & ((d != 2) | (j != 5))
    ).select(
        "process_id",
        _by_place(
            text("t", i), text("x", F.col("c")), "start", "gate", "pack_std", "pack_exp", "end",
            F.when(d == 1, "start2").when(d == 9, "orphan").when(d == 12, "t1").otherwise("u1"), "u2",
        ).alias("id"),
        _by_place(
            task, task, "startEvent", F.when(d == 11, "parallelGateway").otherwise("exclusiveGateway"), task, task,
            "endEvent", F.when(d == 1, "startEvent").otherwise(task), task,
        ).alias("kind"),
        _by_place(
            F.when((d == 3) & first_pick, "A 1").otherwise(aisle), "C01", "", "", "PACK", "EXPRESS", "",
            F.when(d == 1, "").otherwise("A01"), "A01",
        ).alias("aisle"),
        _by_place(F.when((d == 4) & first_pick, aisle).otherwise(alternative), "").alias("alternative"),
        _by_place("", "", "", F.when(d == 5, "").otherwise("service")).alias("variable"),
    )
    small = F.array(
        _node("start", "startEvent"), _node("only", "serviceTask", "A01"), _node("end", "endEvent")
    )
    second = rows.filter("d = 19").select(
        text("q", k).alias("process_id"), F.explode(small).alias("x")
    ).select("process_id", "x.*")
    return listed.unionByName(second)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, spread=True)
    n, extra, d = F.col("n"), F.col("extra"), F.col("d")
    i, c, j = F.col("i"), F.col("c"), F.col("j")
    after_picks = F.when(extra > 0, "x1").otherwise("gate")
    last_target = (
        F.when(d == 6, "missing").when(d == 8, "t1").otherwise(after_picks)
    )
    listed = _elements(rows, F.when(d == 16, 7).otherwise(5)).filter(
        ((d != 15) | (j == 1)) & ((d != 14) | (j != 3))
    ).select(
        "process_id",
        _by_place(
            F.when((d == 18) & (i == 1), "t1").otherwise(text("f", i)), text("g", c),
            "f0", "b1", "b2", "e1", "e2", "u12", "u21",
        ).alias("id"),
        _by_place(text("t", i), text("x", c), "start", "gate", "gate", "pack_std", "pack_exp", "u1", "u2").alias("source"),
        _by_place(
            F.when(i == n, last_target).otherwise(text("t", i + 1)),
            F.when(c == extra, "gate").otherwise(text("x", c + 1)),
            F.when(d == 15, "end").otherwise("t1"), "pack_std", "pack_exp", "end", "end", "u2", "u1",
        ).alias("target"),
        _by_place(
            F.when((d == 7) & (i == n), "stray").otherwise(""), "", "", "standard",
            F.when(d == 10, "standard").otherwise("express"),
        ).alias("value"),
    )
    small = F.array(_flow("f0", "start", "only"), _flow("f1", "only", "end"))
    second = rows.filter("d = 19").select(
        text("q", F.col(K)).alias("process_id"), F.explode(small).alias("x")
    ).select("process_id", "x.*")
    return listed.unionByName(second)


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wave per order; a third of them share one model, the others name the model of their order."""
    k, priority = F.col(K), F.substring("o_orderpriority", 1, 1)
    variables = F.when(
        priority.isin("1", "2"), F.create_map(F.lit("service"), F.lit("express"))
    ).when(priority.isin("3", "4"), F.create_map(F.lit("service"), F.lit("standard")))
    return table(spark, sf_dir, "orders").select(
        text("t", k % 3).alias("tenant_id"),
        text("s", k % 2).alias("site_id"),
        F.when(k % 37 == 5, text("bad ", k)).otherwise(text("w", k)).alias("wave_id"),
        F.when(k % 3 == 0, "p0").otherwise(text("p", k)).alias("process_id"),
        variables.alias("variables"),
        k,
    )


STEP_ORIGIN = "2024-01-01 00:00:00"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resolved wave with its run (r0) and its steps as an array."""
    rows = routes.resolved_waves(
        waves(spark, sf_dir), processes(spark, sf_dir), nodes(spark, sf_dir), flows(spark, sf_dir)
    )
    return rows.withColumns({
        "workflow_id": text("picking/", F.col("tenant_id"), "/", F.col("wave_id")), "run_id": F.lit("r0"),
    })


def steps(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    """Started steps of run r0 of every resolved wave; the last hops have not started."""
    rows = routes.resolved_steps(resolved(spark, sf_dir) if runs is None else runs)
    origin = F.expr(f"timestamp_ntz '{STEP_ORIGIN}'")
    hours = F.expr("interval 1 hour")
    return rows.select(
        "tenant_id", "site_id",
        text("picking/", F.col("tenant_id"), "/", F.col("wave_id")).alias("workflow_id"),
        F.lit("r0").alias("run_id"),
        "wave_id", "hop", "step_id", "aisle", "alternative",
        F.when(F.col("hop") <= 6, origin + hours * F.col("hop")).alias("started_at"),
    )


def as_of() -> Column:
    return F.expr(f"timestamp_ntz '{STEP_ORIGIN}'") + F.expr("interval 7 hours")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per order line; alert ids repeat, some tenants and sites are foreign."""
    k, line, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    aisles = F.array(*[F.lit(a) for a in ("A01", "A02", "B01", "B02", "PACK", "Z99", "A03")])
    tenant = text("t", k % 3)
    return table(spark, sf_dir, "lineitem").select(
        F.when(supp % 13 == 2, "").otherwise(text("al_", F.col("l_partkey") % 40)).alias("alert_id"),
        F.when(supp % 7 == 0, "other").otherwise(tenant).alias("tenant_id"),
        F.when(supp % 11 == 0, "s9").otherwise(text("s", k % 2)).alias("site_id"),
        text("picking/", tenant, "/w", k).alias("workflow_id"),
        F.lit("r0").alias("run_id"),
        F.get(aisles, line - 1).alias("aisle"),
        (
            F.expr(f"timestamp_ntz '{STEP_ORIGIN}'")
            + F.expr("interval 10 minutes") * F.col("l_quantity").cast("int")
        ).alias("received_at"),
    )


# --- the same tables in SQL ------------------------------------------------

MODELS_SQL = """
shape as (
  select o_orderkey as k, o_orderkey % 41 as d, o_orderkey % 5 + 1 as n,
    case o_orderkey % 1009 when 17 then 500 when 18 then 100 else 0 end as extra,
    case when o_orderkey % 41 = 13 then 'p ' else 'p' end || o_orderkey as process_id
  from orders
),
processes as (
  select 'doc' || k as doc_id, process_id, case when d = 17 then 'false' else 'true' end as is_executable,
         case when d = 20 then 1048577 else 4000 end as n_bytes from shape
  union all select 'doc' || k, 'q' || k, 'true', 4000 from shape where d = 19
),
numbered as (select s.*, unnest(range(1, n + 1)) as i from shape s where d <> 15),
chained as (select s.*, unnest(range(1, extra + 1)) as i from shape s where d <> 15),
nodes as (
  select process_id, 'start' as id, 'startEvent' as kind, '' as aisle, '' as alternative, '' as variable
    from shape
  union all select process_id, 'start2', 'startEvent', '', '', '' from shape where d = 1
  union all select process_id, 'end', 'endEvent', '', '', '' from shape where d <> 2
  union all select process_id, 't' || i, 'serviceTask',
      case when d = 3 and i = 1 then 'A 1' else 'A0' || ((k + i) % 3 + 1) end,
      case when d = 4 and i = 1 then 'A0' || ((k + i) % 3 + 1)
           when (k + i) % 4 = 0 then '' else 'B0' || ((k + i) % 3 + 1) end, '' from numbered
  union all select process_id, 'x' || i, 'serviceTask', 'C01', '', '' from chained
  union all select process_id, 'gate', case when d = 11 then 'parallelGateway' else 'exclusiveGateway' end,
      '', '', case when d = 5 then '' else 'service' end from shape where d <> 15
  union all select process_id, 'pack_std', 'serviceTask', 'PACK', '', '' from shape where d <> 15
  union all select process_id, 'pack_exp', 'serviceTask', 'EXPRESS', '', '' from shape where d <> 15
  union all select process_id, 'orphan', 'serviceTask', 'A01', '', '' from shape where d = 9
  union all select process_id, 't1', 'serviceTask', 'A01', '', '' from shape where d = 12
  union all select process_id, unnest(['u1', 'u2']), 'serviceTask', 'A01', '', '' from shape where d = 16
  union all select 'q' || k, 'start', 'startEvent', '', '', '' from shape where d = 19
  union all select 'q' || k, 'only', 'serviceTask', 'A01', '', '' from shape where d = 19
  union all select 'q' || k, 'end', 'endEvent', '', '', '' from shape where d = 19
),
flows as (
  select process_id, 'f0' as id, 'start' as source, case when d = 15 then 'end' else 't1' end as target,
         '' as value from shape
  union all select process_id, case when d = 18 and i = 1 then 't1' else 'f' || i end, 't' || i,
      case when i < n then 't' || (i + 1) when d = 6 then 'missing' when d = 8 then 't1'
           when extra > 0 then 'x1' else 'gate' end,
      case when d = 7 and i = n then 'stray' else '' end from numbered
  union all select process_id, 'g' || i, 'x' || i,
      case when i = extra then 'gate' else 'x' || (i + 1) end, '' from chained
  union all select process_id, 'b1', 'gate', 'pack_std', 'standard' from shape where d <> 15
  union all select process_id, 'b2', 'gate', 'pack_exp',
      case when d = 10 then 'standard' else 'express' end from shape where d not in (14, 15)
  union all select process_id, 'e1', 'pack_std', 'end', '' from shape where d <> 15
  union all select process_id, 'e2', 'pack_exp', 'end', '' from shape where d <> 15
  union all select process_id, 'u12', 'u1', 'u2', '' from shape where d = 16
  union all select process_id, 'u21', 'u2', 'u1', '' from shape where d = 16
  union all select 'q' || k, 'f0', 'start', 'only', '' from shape where d = 19
  union all select 'q' || k, 'f1', 'only', 'end', '' from shape where d = 19
)
"""
WALK_SQL = """,
counts as (
  select process_id, count(*) as n, count(*) filter (kind = 'startEvent') as starts from nodes group by 1
),
walkable as (
  select process_id, n from counts where starts = 1
),
known as (select distinct process_id, id from nodes),
edges as (
  select distinct f.process_id, f.source, f.target
  from flows f join walkable using (process_id)
  join known s on s.process_id = f.process_id and s.id = f.source
  join known t on t.process_id = f.process_id and t.id = f.target
),
walked as (
  select w.process_id, 'start' as id, 0 as depth, n from walkable w
  union
  select w.process_id, e.target, w.depth + 1, w.n
  from walked w join edges e on e.process_id = w.process_id and e.source = w.id
  where w.depth < w.n
)
"""
WAVES_SQL = """,
waves as (
  select 't' || o_orderkey % 3 as tenant_id, 's' || o_orderkey % 2 as site_id,
    case when o_orderkey % 37 = 5 then 'bad ' else 'w' end || o_orderkey as wave_id,
    case when o_orderkey % 3 = 0 then 'p0' else 'p' || o_orderkey end as process_id,
    case when left(o_orderpriority, 1) in ('1', '2') then 'express'
         when left(o_orderpriority, 1) in ('3', '4') then 'standard' else '' end as service
  from orders
),
good_waves as (select * from waves where regexp_matches(wave_id, '^[A-Za-z0-9_-]{1,64}$')),
model_keys as (select process_id, count(*) as n from nodes
               where process_id not in (select process_id from broken) group by 1),
one_node as (select process_id, id, any_value(kind) as kind, any_value(aisle) as aisle,
                    any_value(alternative) as alternative, any_value(variable) as variable
             from nodes group by 1, 2),
pairs as (
  select distinct process_id, service, n from good_waves join model_keys using (process_id)
),
hops as (
  select p.process_id, p.service, p.n, 'start' as id, 0 as hop from pairs p
    join one_node o on o.process_id = p.process_id and o.id = 'start'
  union all
  select h.process_id, h.service, h.n, f.target, h.hop + 1
  from hops h
  join one_node o on o.process_id = h.process_id and o.id = h.id and o.kind <> 'endEvent'
  join flows f on f.process_id = h.process_id and f.source = h.id
   and (o.kind <> 'exclusiveGateway' or f.value = case when o.variable = 'service' then h.service end)
  where h.hop < h.n
),
route_ends as (
  select process_id, service,
    bool_or(kind = 'endEvent') as finished,
    arg_max(h.id, hop) as last_id, max(hop) as last_hop, any_value(n) as n
  from hops h left join one_node o using (process_id, id) group by 1, 2
)
"""
STEPS_SQL = f""",
resolved as (
  select w.tenant_id, w.site_id, w.wave_id, w.process_id,
    row_number() over (partition by w.tenant_id, w.site_id, w.wave_id order by h.hop) as hop,
    o.id as step_id, o.aisle, o.alternative
  from good_waves w
  join route_ends e on e.process_id = w.process_id and e.service = w.service and e.finished
  join hops h on h.process_id = w.process_id and h.service = w.service
  join one_node o on o.process_id = h.process_id and o.id = h.id and o.kind = 'serviceTask'
),
steps as (
  select *, 'picking/' || tenant_id || '/' || wave_id as workflow_id, 'r0' as run_id,
    case when hop <= 6 then timestamp '{STEP_ORIGIN}' + hop * interval '1' hour
         else timestamp '{STEP_ORIGIN}' + interval '7' hour end as boundary, hop <= 6 as started
  from resolved
),
signals as (
  select case when l_suppkey % 13 = 2 then '' else 'al_' || l_partkey % 40 end as alert_id,
    case when l_suppkey % 7 = 0 then 'other' else 't' || l_orderkey % 3 end as tenant_id,
    case when l_suppkey % 11 = 0 then 's9' else 's' || l_orderkey % 2 end as site_id,
    'picking/t' || l_orderkey % 3 || '/w' || l_orderkey as workflow_id, 'r0' as run_id,
    ['A01', 'A02', 'B01', 'B02', 'PACK', 'Z99', 'A03'][l_linenumber] as aisle,
    timestamp '{STEP_ORIGIN}' + cast(l_quantity as integer) * interval '10' minute as received_at
  from lineitem
),
allowed as (
  select distinct tenant_id, site_id, workflow_id, run_id, unnest([aisle, alternative]) as aisle
  from steps
),
accepted as (
  select * from (
    select s.*, row_number() over (
        partition by s.tenant_id, s.site_id, s.workflow_id, s.run_id, s.alert_id
        order by s.received_at, s.aisle) as rn
    from signals s join allowed a using (tenant_id, site_id, workflow_id, run_id, aisle)
    where s.alert_id <> '' and a.aisle <> ''
  ) where rn = 1
),
blocked as (
  select tenant_id, site_id, workflow_id, run_id, aisle, min(received_at) as since
  from accepted group by all
),
judged as (
  select s.*, case when b.since is null or b.since > boundary then s.aisle
                   when alternative <> '' and (c.since is null or c.since > boundary) then alternative
              end as taken
  from steps s
  left join blocked b on b.workflow_id = s.workflow_id and b.tenant_id = s.tenant_id
    and b.site_id = s.site_id and b.aisle = s.aisle
  left join blocked c on c.workflow_id = s.workflow_id and c.tenant_id = s.tenant_id
    and c.site_id = s.site_id and c.aisle = s.alternative
),
stops as (
  select tenant_id, site_id, workflow_id, run_id, min(hop) filter (taken is null) as stop_hop,
         max(boundary) as last_boundary, bool_and(started) as all_started
  from judged group by all
),
drained as (
  select a.* from accepted a join stops s using (tenant_id, site_id, workflow_id, run_id)
  where s.stop_hop is null and s.all_started and a.received_at <= s.last_boundary
)
"""
