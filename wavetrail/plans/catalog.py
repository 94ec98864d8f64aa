"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from wavetrail.plans import (  # noqa: F401
    delivery,
    detection,
    ingestion,
    landing,
    processes,
    table_queries,
)
from wavetrail.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
