"""Reroute application: accepted signals switch later steps to their alternative.

Inputs: `steps(tenant_id, site_id, workflow_id, run_id, hop, step_id, aisle,
alternative, started_at)` and `signals(alert_id, tenant_id, site_id,
workflow_id, run_id, aisle, received_at)`. A route has at most 500 steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.identity import workflow_id
from wavetrail.operators.ordered import first_per
from wavetrail.session import written

RUN = ("tenant_id", "site_id", "workflow_id", "run_id")


def run_identity(runs: DataFrame) -> DataFrame:
    """Runs whose workflow id is the one derived from tenant and wave."""
    return runs.filter(F.col("workflow_id") == workflow_id("tenant_id", "wave_id"))


def allowed_aisles(steps: DataFrame) -> DataFrame:
    """Aisles and alternatives of each run's route."""
    both = steps.select(*RUN, F.explode(F.array("aisle", "alternative")).alias("aisle"))
    return both.filter(F.coalesce(F.col("aisle") != "", F.lit(False))).distinct()


def route_aisles(runs: DataFrame) -> DataFrame:
    """`allowed_aisles` of runs with their `steps` as arrays, of which only the different aisles become rows."""
    both = F.array_union(F.transform("steps", lambda s: s["aisle"]), F.transform("steps", lambda s: s["alternative"]))
    rows = runs.select(*RUN, F.explode(both).alias("aisle"))
    return rows.filter(F.coalesce(F.col("aisle") != "", F.lit(False))).distinct()


def accept_signals(steps: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of a run, for an aisle of its route; the first valid one per alert."""
    return accept_allowed(allowed_aisles(steps), signals)


def accept_allowed(allowed: DataFrame, signals: DataFrame) -> DataFrame:
    """`accept_signals`, given the allowed aisles."""
    named = signals.filter(F.coalesce(F.length("alert_id") > 0, F.lit(False)))
    valid = named.join(allowed, [*RUN, "aisle"], "left_semi")
    return first_per(valid, [*RUN, "alert_id"], ["received_at", "aisle"])


def blocked_since(accepted: DataFrame) -> DataFrame:
    """Earliest accepted signal per run and aisle."""
    return accepted.groupBy(*RUN, "aisle").agg(F.min("received_at").alias("since"))


def _blocked_map(accepted: DataFrame) -> DataFrame:
    """Per run the blocked aisles; only aisles of the route occur, so the map is bounded."""
    return blocked_since(accepted).groupBy(*RUN).agg(
        F.map_from_entries(F.collect_list(F.struct("aisle", "since"))).alias("_blocked")
    )


def walk_steps(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Every step with `taken` (null when no aisle is open) and `stop_hop` of its run.

    A step that has not started is judged at `as_of`.
    """
    at = F.coalesce(F.col("started_at"), as_of)
    is_blocked = lambda aisle: F.coalesce(F.col("_blocked")[aisle] <= at, F.lit(False))
    alternative = F.coalesce("alternative", F.lit(""))
    open_alternative = (alternative != "") & ~is_blocked(alternative)
    taken = F.when(~is_blocked(F.col("aisle")), F.col("aisle")).when(open_alternative, alternative)
    joined = steps.join(_blocked_map(accepted), list(RUN), "left")
    failed = F.when(F.col("taken").isNull(), F.col("hop"))
    return (
        joined.withColumn("boundary", at)
        .withColumn("taken", taken)
        .withColumn("stop_hop", F.min(failed).over(Window.partitionBy(*RUN)))
        .drop("_blocked")
    )


def apply_reroutes(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Executed steps with the aisle taken: those that have started, before the run's first closed step."""
    return planned_steps(steps, accepted, as_of).filter(F.col("started_at").isNotNull())


def planned_steps(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Executed steps and those still to come, with the aisle they would take at `as_of`."""
    walked = walk_steps(steps, accepted, as_of)
    open_ = F.col("stop_hop").isNull() | (F.col("hop") < F.col("stop_hop"))
    return walked.filter(open_).drop("stop_hop", "boundary")


def route_unavailable(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Runs that stop, and the step at which no aisle was open."""
    walked = walk_steps(steps, accepted, as_of)
    return walked.filter(F.col("hop") == F.col("stop_hop")).select(*RUN, "hop", "step_id")


def finished_runs(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Per run whose steps have all started, none of them closed: its ordered steps and last boundary."""
    walked = walk_steps(steps, accepted, as_of).filter(F.col("stop_hop").isNull())
    runs = walked.groupBy(*RUN).agg(
        F.array_sort(F.collect_list(F.struct("hop", "step_id", "taken"))).alias("_steps"),
        F.max("boundary").alias("_last"),
        F.bool_and(F.col("started_at").isNotNull()).alias("_all"),
    )
    return runs.filter("_all").drop("_all")


def _drained(finished: DataFrame, accepted: DataFrame) -> DataFrame:
    joined = accepted.join(finished.select(*RUN, "_last"), list(RUN))
    return joined.filter(F.col("received_at") <= F.col("_last"))


def run_accepted_alerts(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Alerts drained by the finished runs, one row each, numbered in order of acceptance.

    Rows rather than an array: a run may have any number of alerts.
    """
    drained = _drained(finished_runs(steps, accepted, as_of), accepted)
    place = F.row_number().over(Window.partitionBy(*RUN).orderBy("received_at", "alert_id"))
    return drained.select(*RUN, place.cast("long").alias("place"), "alert_id", "aisle", "received_at")


def run_results(steps: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Per finished run: completed step ids, aisles taken, number of accepted alerts.

    The accepted alerts themselves are the rows of `run_accepted_alerts`.
    """
    finished = written(finished_runs(steps, accepted, as_of), "finished")
    counts = _drained(finished, accepted).groupBy(*RUN).agg(F.count("*").alias("n_accepted"))
    return finished.join(counts, list(RUN), "left").select(
        *RUN,
        F.transform("_steps", lambda s: s["step_id"]).alias("completed"),
        F.transform("_steps", lambda s: s["taken"]).alias("aisles"),
        F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
    )


def reroute_missing(results: DataFrame) -> DataFrame:
    """Finished runs that accepted no alert."""
    return results.filter("n_accepted = 0").select(*RUN)
