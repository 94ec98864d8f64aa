"""Queries of model checks, route resolution and reroutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import process_models as pm
from wavetrail.operators import reroutes as rr
from wavetrail.operators import routes
from wavetrail.plans import models
from wavetrail.plans.models import MODELS_SQL, STEPS_SQL, WALK_SQL, WAVES_SQL
from wavetrail.plans.movements import with_
from wavetrail.plans.registry import query
from wavetrail.session import written

ID = "regexp_matches({}, '^[A-Za-z0-9_-]{{1,64}}$')"

# rule query -> SQL over processes, nodes, flows (and walked) giving (process_id, rule, subject)
RULES_SQL = {
    "model_unknown_elements": """
        select process_id, 'unknown_element' as rule, id as subject from nodes
        where kind not in ('startEvent', 'endEvent', 'serviceTask', 'exclusiveGateway')""",
    "model_executable": """
        select process_id, 'not_executable' as rule, process_id as subject from processes
        where is_executable <> 'true'
        union all
        select process_id, 'process_count', doc_id from processes
        where doc_id in (select doc_id from processes group by 1 having count(*) <> 1)""",
    "model_size": """
        select process_id, 'size' as rule, 'bytes' as subject from processes where n_bytes > 1048576
        union all
        select process_id, 'size', 'nodes' from nodes group by process_id having count(*) > 500
        union all
        select process_id, 'size', 'elements' from (
          select process_id from nodes union all select process_id from flows)
        group by process_id having count(*) > 65536""",
    "model_ids": f"""
        select process_id, unnest(rules) as rule, id as subject from (
          select process_id, id, list_filter(
              [case when not {ID.format('id')} then 'invalid_id' end,
               case when count(*) > 1 then 'duplicate_id' end], lambda x: x is not null) as rules
          from (select process_id, process_id as id from processes
                union all select process_id, id from nodes
                union all select process_id, id from flows)
          group by process_id, id)""",
    "model_start_end": """
        select process_id, 'start_end' as rule, 'start' as subject from processes p
        where (select count(*) from nodes n
               where n.process_id = p.process_id and kind = 'startEvent') <> 1
        union all
        select process_id, 'start_end', 'end' from processes p
        where not exists (select 1 from nodes n
                          where n.process_id = p.process_id and kind = 'endEvent')""",
    "model_task_attrs": f"""
        select process_id, 'task_attrs' as rule, id as subject from nodes
        where kind = 'serviceTask' and (not {ID.format('aisle')} or (alternative <> ''
          and (not {ID.format('alternative')} or alternative = aisle)))""",
    "model_gateway_variable": f"""
        select process_id, 'gateway_variable' as rule, id as subject from nodes
        where kind = 'exclusiveGateway' and not {ID.format('variable')}""",
    "model_dangling": """
        select distinct process_id, 'dangling' as rule, e as subject
        from (select process_id, unnest([source, target]) as e from flows)
        where (process_id, e) not in (select process_id, id from nodes)""",
    "model_branch_value_scope": """
        select distinct f.process_id, 'branch_value_scope' as rule, f.source as subject from flows f
        where f.value <> '' and exists (select 1 from nodes n where n.process_id = f.process_id
          and n.id = f.source and n.kind <> 'exclusiveGateway')""",
    "model_degrees": """
        select process_id, 'degrees' as rule, id as subject from (
          select n.process_id, n.id, n.kind, coalesce(i.c, 0) as n_in, coalesce(o.c, 0) as n_out
          from (select distinct process_id, id, kind from nodes) n
          left join (select process_id, target as id, count(*) as c from flows group by 1, 2) i
            using (process_id, id)
          left join (select process_id, source as id, count(*) as c from flows group by 1, 2) o
            using (process_id, id))
        where not case kind when 'startEvent' then n_in = 0 and n_out = 1
                            when 'endEvent' then n_in > 0 and n_out = 0
                            when 'serviceTask' then n_in > 0 and n_out = 1
                            when 'exclusiveGateway' then n_in > 0 and n_out >= 2 else true end""",
    "model_branch_values": f"""
        select distinct f.process_id, 'branch_values' as rule, f.source as subject
        from (select process_id, source, value, count(*) as c from flows group by 1, 2, 3) f
        join nodes n on n.process_id = f.process_id and n.id = f.source and n.kind = 'exclusiveGateway'
        where not {ID.format('f.value')} or f.c > 1""",
    "model_cycles": """
        select distinct process_id, 'cycle' as rule, process_id as subject from walked where depth = n""",
    "model_unreachable": """
        select k.process_id, 'unreachable' as rule, k.id as subject
        from known k join walkable using (process_id)
        where not exists (select 1 from walked w where w.process_id = k.process_id and w.id = k.id)""",
    "model_has_tasks": """
        select process_id, 'has_tasks' as rule, process_id as subject from processes
        where process_id not in (select process_id from nodes where kind = 'serviceTask')""",
}
ALL_SQL = " union all ".join(f"select * from ({sql})" for sql in RULES_SQL.values())


def _sql(select: str) -> str:
    return with_(MODELS_SQL + WALK_SQL, select, recursive=True)


def _tables(spark, sf_dir):
    return models.processes(spark, sf_dir), models.nodes(spark, sf_dir), models.flows(spark, sf_dir)


# rule query -> (checks that find it, names of its rules)
RULE_QUERIES = {
    "model_unknown_elements": (lambda p, n, f: pm.node_rules(n), ["unknown_element"]),
    "model_executable": (lambda p, n, f: pm.process_rules(p), ["not_executable", "process_count"]),
    "model_size": (
        lambda p, n, f: pm.process_rules(p).unionByName(pm.count_rules(p, n, f)), ["size"]
    ),
    "model_ids": (pm.id_rules, ["invalid_id", "duplicate_id"]),
    "model_start_end": (lambda p, n, f: pm.count_rules(p, n, f), ["start_end"]),
    "model_task_attrs": (lambda p, n, f: pm.node_rules(n), ["task_attrs"]),
    "model_gateway_variable": (lambda p, n, f: pm.node_rules(n), ["gateway_variable"]),
    "model_dangling": (pm.id_rules, ["dangling"]),
    "model_branch_value_scope": (pm.id_rules, ["branch_value_scope"]),
    "model_degrees": (lambda p, n, f: pm.degree_rules(n, f), ["degrees"]),
    "model_branch_values": (pm.id_rules, ["branch_values"]),
    "model_cycles": (lambda p, n, f: pm.walk_rules(n, f), ["cycle"]),
    "model_unreachable": (lambda p, n, f: pm.walk_rules(n, f), ["unreachable"]),
    "model_has_tasks": (lambda p, n, f: pm.count_rules(p, n, f), ["has_tasks"]),
}


def _rule_query(name, check, rules) -> None:
    @query(name, _sql(RULES_SQL[name]))
    def violations(spark, sf_dir):
        return check(*_tables(spark, sf_dir)).filter(F.col("rule").isin(*rules))


for _name, (_check, _rules) in RULE_QUERIES.items():
    _rule_query(_name, _check, _rules)


@query("model_violations", _sql(ALL_SQL))
def model_violations(spark, sf_dir):
    return pm.model_violations(*_tables(spark, sf_dir))


_ORDERED = ", ".join(f"'{r}'" for r in pm.RULE_ORDER)


@query(
    "model_first_violation",
    _sql(
        f"""select process_id, rule, subject from (
              select *, row_number() over (partition by process_id
                  order by list_position([{_ORDERED}], rule), subject) as rn from ({ALL_SQL}))
            where rn = 1"""
    ),
)
def model_first_violation(spark, sf_dir):
    return pm.first_violations(*_tables(spark, sf_dir))


@query(
    "valid_models",
    _sql(f"select process_id from processes where process_id not in (select process_id from ({ALL_SQL}))"),
)
def valid_models(spark, sf_dir):
    return pm.valid_models(*_tables(spark, sf_dir))


CATALOG_SQL = "select distinct process_id, id as task_id from nodes where kind = 'serviceTask'"


@query("task_catalog", with_(MODELS_SQL, CATALOG_SQL))
def task_catalog(spark, sf_dir):
    return pm.task_catalog(models.nodes(spark, sf_dir))


@query(
    "model_summary",
    with_(
        MODELS_SQL,
        """select process_id, coalesce(n.c, 0) as n_nodes, coalesce(f.c, 0) as n_flows from processes
           left join (select process_id, count(*) as c from nodes group by 1) n using (process_id)
           left join (select process_id, count(*) as c from flows group by 1) f using (process_id)""",
    ),
)
def model_summary(spark, sf_dir):
    return pm.model_summary(*_tables(spark, sf_dir))


@query(
    "catalog_drift",
    with_(
        MODELS_SQL,
        f"""select process_id, 'gone' as task_id, 'stored' as side
            from (select distinct process_id from ({CATALOG_SQL})) where process_id like '%7'
            union all
            select process_id, task_id, 'computed' from ({CATALOG_SQL}) where process_id like '%8' and task_id = 't1'""",
    ),
)
def catalog_drift(spark, sf_dir):
    """Some stored rows name a task that the model has lost, some new tasks are not stored yet."""
    computed = pm.task_catalog(models.nodes(spark, sf_dir))
    new = F.col("process_id").endswith("8") & (F.col("task_id") == "t1")
    lost = computed.filter(F.col("process_id").endswith("7")).select("process_id").distinct()
    stored = computed.filter(~new).unionByName(lost.withColumn("task_id", F.lit("gone")))
    return pm.catalog_drift(stored, computed)


# --- routes ---------------------------------------------------------------


def _route_sql(select: str) -> str:
    broken = f", broken as (select distinct process_id from ({ALL_SQL}))"
    return with_(MODELS_SQL + WALK_SQL + broken + WAVES_SQL + STEPS_SQL, select, recursive=True)


@query(
    "resolve_routes",
    _route_sql(
        "select tenant_id, site_id, wave_id, process_id, hop, step_id, aisle, alternative from resolved"
    ),
)
def resolve_routes(spark, sf_dir):
    rows = routes.resolve_routes(models.waves(spark, sf_dir), *_tables(spark, sf_dir))
    return rows.withColumn("hop", F.col("hop").cast("long"))


@query(
    "route_errors",
    _route_sql(
        """select tenant_id, site_id, wave_id, process_id,
             case when not regexp_matches(wave_id, '^[A-Za-z0-9_-]{1,64}$') then 'invalid_input'
                  when process_id not in (select process_id from processes) then 'unknown_process'
                  when process_id in (select process_id from broken) then 'invalid_model'
                  else 'no_branch' end as reason
           from (select w.*, e.finished, e.last_id, e.last_hop, e.n, o.kind
                 from waves w left join route_ends e using (process_id, service)
                 left join one_node o on o.process_id = w.process_id and o.id = e.last_id) q
           where not regexp_matches(wave_id, '^[A-Za-z0-9_-]{1,64}$')
              or process_id not in (select process_id from model_keys)
              or not coalesce(finished, true)"""
    ),
)
def route_errors(spark, sf_dir):
    return routes.route_errors(models.waves(spark, sf_dir), *_tables(spark, sf_dir))


# --- reroutes -------------------------------------------------------------

RUN_SQL = "tenant_id, site_id, workflow_id, run_id"


def _accepted(spark, sf_dir):
    """Steps and accepted signals: both are read more than once, so the runs and the signals are written."""
    runs = written(models.resolved(spark, sf_dir), "runs")
    accepted = rr.accept_allowed(rr.route_aisles(runs), models.signals(spark, sf_dir))
    return models.steps(spark, sf_dir, runs), written(accepted, "accepted")


def _accepted_once(spark, sf_dir):
    """Accepted signals where nothing else is read: no table of them or of the runs is written."""
    return rr.accept_allowed(rr.route_aisles(models.resolved(spark, sf_dir)), models.signals(spark, sf_dir))


@query("allowed_aisles", _route_sql(f"select {RUN_SQL}, aisle from allowed where aisle <> ''"))
def allowed_aisles(spark, sf_dir):
    return rr.route_aisles(models.resolved(spark, sf_dir))


@query(
    "accept_signals",
    _route_sql(f"select {RUN_SQL}, alert_id, aisle, cast(received_at as varchar) as received_at from accepted"),
)
def accept_signals(spark, sf_dir):
    return _accepted_once(spark, sf_dir).select(
        *rr.RUN, "alert_id", "aisle", F.col("received_at").cast("string").alias("received_at")
    )


@query(
    "blocked_since",
    _route_sql(f"select {RUN_SQL}, aisle, cast(since as varchar) as since from blocked"),
)
def blocked_since(spark, sf_dir):
    rows = rr.blocked_since(_accepted_once(spark, sf_dir))
    return rows.select(*rr.RUN, "aisle", F.col("since").cast("string").alias("since"))


@query(
    "apply_reroutes",
    _route_sql(
        f"""select {RUN_SQL}, hop, step_id, aisle, taken
            from judged join stops using ({RUN_SQL}) where started and (stop_hop is null or hop < stop_hop)"""
    ),
)
def apply_reroutes(spark, sf_dir):
    rows = rr.apply_reroutes(*_accepted(spark, sf_dir), models.as_of())
    return rows.select(*rr.RUN, F.col("hop").cast("long").alias("hop"), "step_id", "aisle", "taken")


@query(
    "route_unavailable",
    _route_sql(
        f"select {RUN_SQL}, hop, step_id from judged join stops using ({RUN_SQL}) where hop = stop_hop"
    ),
)
def route_unavailable(spark, sf_dir):
    rows = rr.route_unavailable(*_accepted(spark, sf_dir), models.as_of())
    return rows.withColumn("hop", F.col("hop").cast("long"))


@query(
    "run_identity",
    _route_sql(
        """select distinct workflow_id, wave_id from (
             select tenant_id, wave_id, case when hop % 2 = 0 then workflow_id || 'x'
                                             else workflow_id end as workflow_id from steps)
           where workflow_id = 'picking/' || tenant_id || '/' || wave_id"""
    ),
)
def run_identity(spark, sf_dir):
    steps = models.steps(spark, sf_dir)
    forged = F.when(F.col("hop") % 2 == 0, F.concat("workflow_id", F.lit("x"))).otherwise(
        F.col("workflow_id")
    )
    rows = rr.run_identity(steps.withColumn("workflow_id", forged))
    return rows.select("workflow_id", "wave_id").distinct()


@query(
    "run_results",
    _route_sql(
        f"""select {RUN_SQL}, completed, aisles, coalesce(n, 0) as n_accepted
            from (select {RUN_SQL}, string_agg(step_id, ',' order by hop) as completed,
                         string_agg(taken, ',' order by hop) as aisles
                  from judged join stops using ({RUN_SQL}) where stop_hop is null and all_started group by all)
            left join (select {RUN_SQL}, count(*) as n from drained group by all) using ({RUN_SQL})"""
    ),
)
def run_results(spark, sf_dir):
    rows = rr.run_results(*_accepted(spark, sf_dir), models.as_of())
    return rows.select(
        *rr.RUN,
        F.array_join("completed", ",").alias("completed"),
        F.array_join("aisles", ",").alias("aisles"),
        "n_accepted",
    )


@query(
    "run_accepted_alerts",
    _route_sql(
        f"""select {RUN_SQL}, row_number() over (partition by {RUN_SQL} order by received_at, alert_id) as place,
              alert_id, aisle, cast(received_at as varchar) as received_at from drained"""
    ),
)
def run_accepted_alerts(spark, sf_dir):
    rows = rr.run_accepted_alerts(*_accepted(spark, sf_dir), models.as_of())
    return rows.withColumn("received_at", F.col("received_at").cast("string"))


@query(
    "reroute_missing",
    _route_sql(
        f"""select {RUN_SQL} from stops where stop_hop is null and all_started
            and ({RUN_SQL}) not in (select {RUN_SQL} from drained)"""
    ),
)
def reroute_missing(spark, sf_dir):
    return rr.reroute_missing(rr.run_results(*_accepted(spark, sf_dir), models.as_of()))
