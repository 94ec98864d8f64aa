"""Alert outbox: pending selection, delivery outcomes, backoff, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.identity import retry_delay_seconds, seconds_interval
from wavetrail.operators.ordered import first_per
from wavetrail.session import small_side

ALERT_KEY = ("tenant_id", "alert_id")
# Rows per tenant and pass, attempts before an alert is dead, error size.
PASS_LIMIT = 100
MAX_ATTEMPTS = 8
MAX_ERROR_BYTES = 2000
NOT_FOUND = "alert not found"


def is_pending(now: Column) -> Column:
    """Undelivered, not dead, and due (a due time equal to `now` counts)."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return F.col("delivered_at").isNull() & ~F.col("dead") & due


def pending_alerts(alerts: DataFrame, now: Column) -> DataFrame:
    return alerts.filter(is_pending(now))


def pending_top_k(alerts: DataFrame, now: Column, k: int = PASS_LIMIT) -> DataFrame:
    """At most `k` pending alerts per tenant, oldest first.

    The rank limit is applied before the shuffle as well, so a tenant with most
    of the alerts sends at most `k` rows per task.
    """
    w = Window.partitionBy("tenant_id").orderBy("created_at", "alert_id")
    ranked = pending_alerts(alerts, now).withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def dispatch_scope(alerts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Alerts of tenants that hold a token."""
    tenants = tokens.select("tenant_id").distinct()
    return alerts.join(small_side(tenants), "tenant_id", "left_semi")


def truncate_error(message: Column) -> Column:
    """The first 2000 bytes of the text; a character cut in half is left out."""
    data = F.encode(message, "UTF-8")
    # a character has at most four bytes: the longest of these prefixes that is valid ends with a whole one
    heads = [F.substring(data, 1, MAX_ERROR_BYTES - i).cast("string") for i in range(4)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads], F.make_valid_utf8(heads[0]))
    return F.when(F.octet_length(message) <= MAX_ERROR_BYTES, message).otherwise(whole)


def is_dead(attempts_before: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Dead after this failed attempt."""
    return attempts_before + 1 >= max_attempts


def unmatched(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that name no alert; an update of them is an error."""
    return ids.join(alerts.select(*ALERT_KEY), list(ALERT_KEY), "left_anti")


def _apply(alerts: DataFrame, hits: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Left-join `hits` (columns prefixed `_`) and replace columns of matched rows."""
    joined = alerts.join(hits, list(ALERT_KEY), "left")
    hit = F.col("_hit").isNotNull()
    changed = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}
    return joined.withColumns(changed).select(*alerts.columns)


def mark_delivered(alerts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The alert table after delivery of `ids` (tenant_id, alert_id)."""
    hits = ids.select(*ALERT_KEY).distinct().withColumn("_hit", F.lit(True))
    return _apply(alerts, hits, {"delivered_at": now, "last_error": F.lit("")})


def mark_failed(
    alerts: DataFrame, failures: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """The alert table after failed attempts (tenant_id, alert_id, error), one per alert."""
    one = first_per(failures.select(*ALERT_KEY, "error"), ALERT_KEY, ["error"])
    hits = one.select(*ALERT_KEY, F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    attempt = F.col("attempts") + 1
    changes = {
        "dead": is_dead(F.col("attempts"), max_attempts),
        "last_error": truncate_error(F.coalesce("_error", F.lit(""))),
        "next_attempt_at": now + seconds_interval(retry_delay_seconds(attempt)),
        "attempts": attempt,
    }
    return _apply(alerts, hits, changes)


def dead_letters(alerts: DataFrame) -> DataFrame:
    """Alerts that are given up and were not delivered."""
    return alerts.filter(F.col("dead") & F.col("delivered_at").isNull())


def one_outcome(outcomes: DataFrame) -> DataFrame:
    """One outcome per alert: a success counts; else the first error in order."""
    return outcomes.groupBy(*ALERT_KEY).agg(F.bool_or("ok").alias("ok"), F.min("error").alias("error"))


def attempted(
    alerts: DataFrame, outcomes: DataFrame, tokens: DataFrame, now: Column, k: int = PASS_LIMIT
) -> DataFrame:
    """Alerts of one pass with the outcome of their signal (ok, error), one row per alert."""
    chosen = pending_top_k(dispatch_scope(alerts, tokens), now, k).select(*ALERT_KEY)
    return chosen.join(one_outcome(outcomes), list(ALERT_KEY))


def dispatch_pass(
    alerts: DataFrame,
    outcomes: DataFrame,
    tokens: DataFrame,
    now: Column,
    max_attempts: int = MAX_ATTEMPTS,
    k: int = PASS_LIMIT,
) -> DataFrame:
    """The alert table after one dispatch pass."""
    tried = attempted(alerts, outcomes, tokens, now, k)
    hits = tried.select(
        *ALERT_KEY, F.col("ok").alias("_ok"), F.col("error").alias("_error"),
        F.lit(True).alias("_hit"),
    )
    ok, attempt = F.col("_ok"), F.col("attempts") + 1
    error = truncate_error(F.coalesce("_error", F.lit("")))
    changes = {
        "delivered_at": F.when(ok, now).otherwise(F.col("delivered_at")),
        "last_error": F.when(ok, "").otherwise(error),
        "dead": F.when(ok, F.col("dead")).otherwise(is_dead(F.col("attempts"), max_attempts)),
        "next_attempt_at": F.when(ok, F.col("next_attempt_at")).otherwise(
            now + seconds_interval(retry_delay_seconds(attempt))
        ),
        "attempts": F.when(ok, F.col("attempts")).otherwise(attempt),
    }
    return _apply(alerts, hits, changes)


def dispatch_failures(
    alerts: DataFrame, outcomes: DataFrame, tokens: DataFrame, now: Column, k: int = PASS_LIMIT
) -> DataFrame:
    """Error report of a pass: failed signals, and outcomes that name no alert."""
    failed = attempted(alerts, outcomes, tokens, now, k).filter(~F.col("ok"))
    prefix = F.concat(F.lit("alert "), "alert_id", F.lit(": "))
    report = failed.select(*ALERT_KEY, F.concat(prefix, "error").alias("message"))
    lost = unmatched(alerts, outcomes.select(*ALERT_KEY).distinct()).select(*ALERT_KEY, F.lit(NOT_FOUND).alias("message"))
    return report.unionByName(lost)


def outbox_state(
    alerts: DataFrame, attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Current state of append-only alerts from the log (tenant_id, alert_id, at, ok, error)."""
    failed = ~F.col("ok")
    log = attempts.groupBy(*ALERT_KEY).agg(
        F.count_if(failed).alias("_failed"),
        F.max(F.when(failed, F.struct("at", "error"))).alias("_last"),
        F.min(F.when(F.col("ok"), F.col("at"))).alias("_delivered"),
    )
    fixed = [
        c for c in alerts.columns
        if c not in ("delivered_at", "last_error", "attempts", "next_attempt_at", "dead")
    ]
    count = F.coalesce("_failed", F.lit(0)).cast("long")
    return alerts.select(*fixed).join(log, list(ALERT_KEY), "left").select(
        *fixed,
        F.col("_delivered").alias("delivered_at"),
        F.when(F.col("_delivered").isNotNull(), "")
        .otherwise(F.coalesce(truncate_error(F.col("_last.error")), F.lit("")))
        .alias("last_error"),
        count.alias("attempts"),
        (F.col("_last.at") + seconds_interval(retry_delay_seconds(count))).alias("next_attempt_at"),
        (count >= max_attempts).alias("dead"),
    )
