"""Stored-table rules: defaults, validators, and rewrites for update and delete.

Queries need no layer of their own: filter, order, limit and aggregate are used
as they are. A change returns the new table; writing it is left to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail import schemas
from wavetrail.operators.ordered import global_positions

TABLES: dict[str, T.StructType] = {
    "observations": schemas.OBSERVATION,
    "alerts": schemas.ALERT,
    "process_tasks": schemas.PROCESS_TASK,
}
# Column defaults beside id and created_at.
ALERT_DEFAULTS = {"last_error": "", "attempts": 0, "dead": False}


def with_defaults(rows: DataFrame, table: str, now: Column) -> DataFrame:
    """Fill absent ids, creation times and defaults; add absent nullable columns."""
    schema = TABLES[table]
    defaults: dict[str, Column] = {"id": F.uuid(), "created_at": now}
    if table == "alerts":
        defaults |= {c: F.lit(v) for c, v in ALERT_DEFAULTS.items()}
    out = []
    for f in schema.fields:
        given = F.col(f.name) if f.name in rows.columns else F.lit(None)
        value = F.coalesce(given, defaults[f.name]) if f.name in defaults else given
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def row_violations(rows: DataFrame, table: str, task_ids: DataFrame | None = None) -> DataFrame:
    """Rows that break a validator, with `violation`.

    `task_ids` is the task catalog; only process tasks are checked against it.
    """
    required = [f.name for f in TABLES[table].fields if not f.nullable and f.name != "id"]
    reason = F.when(F.coalesce(F.length("tenant_id"), F.lit(0)) == 0, "tenant_id is empty")
    for c in required:
        reason = reason.when(F.col(c).isNull(), f"{c} is missing")
    if table == "observations":
        reason = reason.when(F.isnan("seconds") | (F.col("seconds") <= 0), "seconds is not positive")
    if table == "process_tasks" and task_ids is not None:
        known = task_ids.select("task_id", F.lit(True).alias("_known")).distinct()
        rows = rows.join(known, "task_id", "left")
        reason = reason.when(F.col("_known").isNull(), "task_id is not in the catalog")
    marked = rows.withColumn("violation", reason).filter(F.col("violation").isNotNull())
    return marked.drop("_known")


def create_bulk(
    stored: DataFrame, rows: DataFrame, table: str, now: Column, task_ids: DataFrame | None = None
) -> DataFrame:
    """The table with all `rows` added, or ValueError and no change at all."""
    filled = with_defaults(rows, table, now)
    shown = row_violations(filled, table, task_ids).limit(5).collect()
    if shown:
        raise ValueError(f"invalid rows: {[r['violation'] for r in shown]}")
    key = list(schemas.UNIQUE_KEYS[table])
    both = stored.select(*key).unionByName(filled.select(*key))
    if not both.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate {key}")
    return stored.unionByName(filled)


def matches(predicate: Column) -> Column:
    """Predicate with unknown counted as no match, as in a WHERE clause."""
    return F.coalesce(predicate, F.lit(False))


def update_where(rows: DataFrame, predicate: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows with `changes` applied where the predicate holds; None clears a column."""
    hit = matches(predicate)
    values = {
        c: F.when(hit, F.lit(None) if v is None else v).otherwise(F.col(c)).cast(rows.schema[c].dataType)
        for c, v in changes.items()
    }
    return rows.withColumns(values)


def update_one(rows: DataFrame, key: Column, changes: dict[str, Column]) -> DataFrame:
    """Update of one row; LookupError when it is absent."""
    require_one(rows.filter(matches(key)))
    return update_where(rows, key, changes)


def delete_where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that stay after the matching ones are deleted."""
    return rows.filter(~matches(predicate))


def delete_one(rows: DataFrame, key: Column) -> DataFrame:
    """Delete of one row; LookupError when it is absent."""
    require_one(rows.filter(matches(key)))
    return delete_where(rows, key)


def require_one(rows: DataFrame) -> DataFrame:
    """Exactly one row, otherwise LookupError (none) or ValueError (several)."""
    n = rows.limit(2).count()
    if n == 0:
        raise LookupError("not found")
    if n > 1:
        raise ValueError("not singular")
    return rows


def require_first(rows: DataFrame) -> DataFrame:
    """The first row in the given order, LookupError when there is none."""
    one = rows.limit(1)
    if one.isEmpty():
        raise LookupError("not found")
    return one


def skip_rows(rows: DataFrame, order: Sequence[str], n: int, chunks: int = 200) -> DataFrame:
    """All rows after the first `n` in the total order `order`.

    Positions come from range chunks, since a plain OFFSET would move every row
    through one task.
    """
    placed = global_positions(rows, order, chunks)
    return placed.filter(F.col("position") > n).drop("position")
