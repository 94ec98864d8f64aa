"""Process-task receipts and uniqueness checks of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.functions.identity import valid_id, workflow_id
from wavetrail.operators.ordered import first_per
from wavetrail.session import small_side

RECEIPT_KEY = ("tenant_id", "workflow_id", "run_id", "task_id")


def record_receipts(
    receipts: DataFrame, arrival: Sequence[str], stored: DataFrame | None = None
) -> DataFrame:
    """New receipts: the first per key whose key is not stored; retries change nothing."""
    first = first_per(receipts, RECEIPT_KEY, arrival)
    if stored is None:
        return first
    return first.join(stored.select(*RECEIPT_KEY), list(RECEIPT_KEY), "left_anti")


def check_task_enum(receipts: DataFrame, task_ids: DataFrame) -> DataFrame:
    """Receipts whose task is not in the catalog (column `task_id`)."""
    return receipts.join(small_side(task_ids.select("task_id").distinct()), "task_id", "left_anti")


def receipt_identity(receipts: DataFrame) -> DataFrame:
    """Receipts with valid input ids whose workflow id is the derived one."""
    ids = valid_id("tenant_id") & valid_id("site_id") & valid_id("wave_id")
    return receipts.filter(ids & (F.col("workflow_id") == workflow_id("tenant_id", "wave_id")))


def uniqueness_violations(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of copies."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
