"""Identity rules: identifiers, workflow ids, stable hashes, retry delay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier format, the workflow id prefix, the alert hash suffix.
IDENTIFIER = r"^[A-Za-z0-9_-]{1,64}\z"
WORKFLOW_PREFIX = "picking/"
ALERT_SUFFIX = "congestion-v1"
MAX_BACKOFF_EXPONENT = 6


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def valid_id(value: str | Column) -> Column:
    """True for 1-64 ASCII letters, digits, `_` or `-`; null counts as invalid.

    `\\z` rather than `$`: the Java `$` would also accept a trailing newline.
    """
    return F.coalesce(as_column(value).rlike(IDENTIFIER), F.lit(False))


def workflow_id(tenant: str | Column, wave: str | Column) -> Column:
    """`picking/<tenant>/<wave>`; null when either part is null."""
    return F.concat(F.lit(WORKFLOW_PREFIX), as_column(tenant), F.lit("/"), as_column(wave))


def stable_id(*parts: str | Column) -> Column:
    """Hex sha256 over `<byte length>:<part>` of every part, in order."""
    pieces: list[Column] = []
    for part in parts:
        col = as_column(part)
        pieces += [F.octet_length(col).cast("string"), F.lit(":"), col]
    return F.sha2(F.concat(*pieces), 256)


def event_id(tenant, workflow, run, task) -> Column:
    return stable_id(tenant, workflow, run, task)


def alert_id(tenant, event) -> Column:
    return stable_id(tenant, event, F.lit(ALERT_SUFFIX))


def retry_delay_seconds(attempts: str | Column) -> Column:
    """2, 4, 8, ... seconds for attempt 1, 2, 3, ..., capped at 64."""
    exponent = F.least(as_column(attempts), F.lit(MAX_BACKOFF_EXPONENT))
    return F.pow(F.lit(2.0), exponent).cast("int")


def seconds_interval(seconds: str | Column) -> Column:
    """A day-time interval of the given number of seconds."""
    return F.make_dt_interval(secs=as_column(seconds).cast("decimal(18,6)"))
