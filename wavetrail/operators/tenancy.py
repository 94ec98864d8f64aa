"""Tenant isolation as data rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTABLE_ALERT_COLUMNS = ("delivered_at", "last_error", "attempts", "next_attempt_at", "dead")


def require_tenant(tenant: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", tenant):
        raise ValueError("invalid tenant")
    return tenant


def tenant_scope(rows: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of the tenant; none when no tenant is set. Prunes tenant partitions."""
    if tenant is None:
        return rows.filter(F.lit(False))
    return rows.filter(F.col("tenant_id") == require_tenant(tenant))


def tenant_write_check(rows: DataFrame, tenant: str | None) -> DataFrame:
    """Rows a writer of `tenant` must not write."""
    if tenant is None:
        return rows
    return rows.filter(~F.col("tenant_id").eqNullSafe(require_tenant(tenant)))


def pair_violations(log: DataFrame) -> DataFrame:
    """Log rows whose alert belongs to another tenant than the observation."""
    return log.filter(
        F.col("alert").isNotNull() & ~F.col("alert.tenant_id").eqNullSafe(F.col("tenant_id"))
    )


def require_tenant_rows(rows: DataFrame, tenant: str) -> DataFrame:
    """The rows, or PermissionError when one belongs to another tenant."""
    if not tenant_write_check(rows, tenant).isEmpty():
        raise PermissionError("row of another tenant")
    return rows


def immutable_columns(
    old: DataFrame,
    new: DataFrame,
    key: Sequence[str] = ("id",),
    mutable: Sequence[str] = MUTABLE_ALERT_COLUMNS,
) -> DataFrame:
    """Keys whose immutable columns differ, with the names of the changed columns."""
    fixed = [c for c in old.columns if c not in (*key, *mutable)]
    before = old.select(*key, F.struct(*fixed).alias("_old"))
    after = new.select(*key, F.struct(*fixed).alias("_new"))
    changed = F.array_compact(
        F.array(
            *[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), c) for c in fixed]
        )
    )
    return (
        before.join(after, list(key))
        .select(*key, changed.alias("changed"))
        .filter(F.size("changed") > 0)
    )
