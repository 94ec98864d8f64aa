"""Route resolution: waves walk a valid process model to an ordered list of steps.

Waves that give the same values to a model's gateway variables take the same route, whichever
model of that graph they name, so each (graph, values) pair is walked once and joined back to its waves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.functions.identity import valid_id
from wavetrail.operators.process_models import (
    END, GATEWAY, PID, START, TASK, document_refused, packed_models, process_rules, refused_models,
    shared_graphs,
)
from wavetrail.session import small_side, written

WAVE_KEY = ("tenant_id", "site_id", "wave_id")
# a model that more waves name is broadcast to them, so that they do not meet in one task
HOT_WAVES = 100_000
DONE, RUNNING = "done", "running"


def valid_input() -> Column:
    return valid_id("tenant_id") & valid_id("site_id") & valid_id("wave_id")


def model_graphs(graphs: DataFrame) -> DataFrame:
    """Per graph of a valid model: `graph`, `outgoing`, `start`, `variables`, `n_nodes`.

    `graph` maps a node id to its kind and step, `outgoing` a node id to its
    targets by branch value. A valid model has a bounded number of nodes, each id once.
    """
    of_kind = lambda kind, field: F.transform(
        F.filter("nodes", lambda n: n["kind"] == kind), lambda n: n[field]
    )
    sources = F.array_distinct(F.transform("flows", lambda f: f["source"]))
    targets = lambda s: F.map_from_entries(F.transform(
        F.filter("flows", lambda f: f["source"] == s), lambda f: F.struct(f["value"], f["target"])
    ))
    return graphs.select(
        "graph_id",
        F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["id"], n))).alias("graph"),
        F.array_min(of_kind(START, "id")).alias("start"),
        F.array_sort(F.array_distinct(of_kind(GATEWAY, "variable"))).alias("variables"),
        F.size("nodes").alias("n_nodes"),
        F.map_from_entries(F.transform(sources, lambda s: F.struct(s, targets(s)))).alias("outgoing"),
    )


def _walk() -> Column:
    """Fold over hops: (node, status, steps); hop count bounded by the node count."""
    step_type = "array<struct<id:string,aisle:string,alternative:string>>"
    first = F.struct(
        F.col("graph")[F.col("start")].alias("node"),
        F.lit(RUNNING).alias("status"),
        F.array().cast(step_type).alias("steps"),
    )

    def hop(acc: Column, _: Column) -> Column:
        node = acc["node"]
        kind = node["kind"]
        targets = F.col("outgoing")[node["id"]]
        branch = targets[F.col("choices")[node["variable"]]]
        # other nodes of a valid model have exactly one outgoing flow
        target = F.when(kind == GATEWAY, branch).otherwise(F.get(F.map_values(targets), F.lit(0)))
        moved = F.struct(
            F.col("graph")[target].alias("node"),
            F.when((kind == GATEWAY) & target.isNull(), "no_branch").otherwise(RUNNING).alias("status"),
            F.when(
                kind == TASK,
                F.concat(acc["steps"], F.array(F.struct(node["id"], node["aisle"], node["alternative"]))),
            ).otherwise(acc["steps"]).cast(step_type).alias("steps"),
        )
        ended = lambda status: F.struct(
            node.alias("node"), F.lit(status).alias("status"), acc["steps"].alias("steps")
        )
        return (
            F.when(acc["status"] != RUNNING, acc)
            .when(node.isNull(), ended("unknown_node"))
            .when(kind == END, ended(DONE))
            .otherwise(moved)
        )

    return F.aggregate(F.sequence(F.lit(0), F.col("n_nodes")), first, hop)


def _with_models(waves: DataFrame, models: DataFrame, how: str = "inner") -> DataFrame:
    """Waves joined to what is known of their models (`n_used` is the number of waves that name one)."""
    hot = written(models.filter(F.col("n_used") > HOT_WAVES), "hot")
    if hot.isEmpty():
        return waves.join(small_side(models), PID, how)
    hot = small_side(hot)
    rest = waves.join(hot.select(PID), PID, "left_anti")
    others = small_side(models.filter(F.col("n_used") <= HOT_WAVES))
    return rest.join(others, PID, how).unionByName(waves.join(hot, PID))


def _choices(waves: DataFrame, valid: DataFrame, walkable: DataFrame) -> DataFrame:
    """Waves of a valid model with its graph and `choices`: the graph's gateway variables and the wave's values."""
    variables = walkable.select("graph_id", F.col("variables").alias("_names"))
    given = F.coalesce(F.col("variables"), F.create_map().cast("map<string,string>"))
    values = F.transform("_names", lambda n: F.struct(n, F.coalesce(given[n], F.lit(""))))
    return (
        _with_models(waves.filter(valid_input()), valid)
        .join(small_side(variables), "graph_id")
        .select(*WAVE_KEY, PID, "graph_id", values.alias("choices"))
    )


def named_models(
    waves: DataFrame, processes: DataFrame, nodes: DataFrame, flows: DataFrame,
    document_violations: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Known models that some wave names, with `refused` (the model has a violation), `graph_id` and `n_used` (the number
    of their waves), and their graphs.

    Both are materialised: nodes and flows are packed once, and every rule and the walk read the
    written graphs. What is known of a model, its waves included, meets in the one shuffle of its elements.
    """
    # a document is judged with all its processes, named by a wave or not
    refused = process_rules(processes.filter("doc_id is not null")).select(PID)
    of_document = document_refused(processes, document_violations)
    if of_document is not None:
        refused = refused.unionByName(of_document)
    models, listed = packed_models(processes, nodes, flows, waves.select(PID), refused)
    keys, graphs = shared_graphs(models)
    columns = (PID, "refused", "graph_id", "n_used")
    named = refused_models(keys, graphs).filter("n_processes > 0").select(*columns)
    if listed is not None:
        # an oversize model breaks the size rule
        large = listed.filter("n_processes > 0").withColumns({"refused": F.lit(True), "graph_id": F.lit(None).cast("string")})
        named = named.unionByName(large.select(*columns))
    return written(named, "named"), graphs


def wave_routes(waves: DataFrame, named: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per wave with valid input and a valid model of `named_models`: `status` and `steps`."""
    valid = named.filter(~F.col("refused")).select(PID, "graph_id", "n_used")
    walked = graphs.withColumnRenamed(PID, "graph_id")
    walked = walked.join(small_side(valid.select("graph_id").distinct()), "graph_id", "left_semi")
    walkable = written(model_graphs(walked), "walkable")
    # read twice: for the distinct routes, and with them
    chosen = written(_choices(waves, valid, walkable), "chosen")
    distinct = chosen.select("graph_id", "choices").distinct()
    routes = (
        distinct.join(walkable.drop("variables"), "graph_id")
        .withColumn("_pairs", F.col("choices"))
        .withColumn("choices", F.map_from_entries("choices"))
        # a generator, unlike a projection, is not evaluated again in later filters
        .select("graph_id", "_pairs", F.inline(F.array(_walk())))
        .select(
            "graph_id",
            F.col("_pairs").alias("choices"),
            F.when(F.col("status") == RUNNING, "hop_bound").otherwise(F.col("status")).alias("status"),
            "steps",
        )
    )
    return chosen.join(small_side(written(routes, "routes")), ["graph_id", "choices"]).drop("graph_id", "choices")


def resolved_waves(
    waves: DataFrame, processes: DataFrame, nodes: DataFrame, flows: DataFrame,
    document_violations: DataFrame | None = None,
) -> DataFrame:
    """Every wave whose walk of a valid model reaches an end, with `steps`: (id, aisle, alternative) in order."""
    named, graphs = named_models(waves, processes, nodes, flows, document_violations)
    return wave_routes(waves, named, graphs).filter(F.col("status") == DONE).drop("status")


def resolved_steps(resolved: DataFrame) -> DataFrame:
    """The steps of `resolved_waves` as rows: (hop, step_id, aisle, alternative)."""
    return resolved.select(*WAVE_KEY, PID, F.posexplode("steps").alias("_pos", "_step")).select(
        *WAVE_KEY,
        PID,
        (F.col("_pos") + 1).alias("hop"),
        F.col("_step.id").alias("step_id"),
        F.col("_step.aisle").alias("aisle"),
        F.col("_step.alternative").alias("alternative"),
    )


def resolve_routes(
    waves: DataFrame, processes: DataFrame, nodes: DataFrame, flows: DataFrame,
    document_violations: DataFrame | None = None,
) -> DataFrame:
    """Steps of every wave whose walk of a valid model reaches an end: (hop, step_id, aisle, alternative)."""
    return resolved_steps(resolved_waves(waves, processes, nodes, flows, document_violations))


def route_errors(
    waves: DataFrame, processes: DataFrame, nodes: DataFrame, flows: DataFrame,
    document_violations: DataFrame | None = None,
) -> DataFrame:
    """Waves without a route and why: invalid_input, unknown_process, invalid_model or no_branch."""
    named, graphs = named_models(waves, processes, nodes, flows, document_violations)
    told = _with_models(waves.select(*WAVE_KEY, PID, valid_input().alias("_ok")), named.drop("graph_id"), "left")
    reason = (
        F.when(~F.col("_ok"), "invalid_input")
        .when(F.col("refused").isNull(), "unknown_process")
        .when(F.col("refused"), "invalid_model")
    )
    early = told.select(*WAVE_KEY, PID, reason.alias("reason")).filter("reason is not null")
    stopped = wave_routes(waves, named, graphs).filter(F.col("status") != DONE)
    return early.unionByName(stopped.select(*WAVE_KEY, PID, F.col("status").alias("reason")))
