"""Row-at-a-time detector used as brute force: the rules, written as a loop."""

from __future__ import annotations

import math
import re
from datetime import timedelta

ID = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")


def outcomes(rows, baselines, config):
    """rows in arrival order as dicts -> list of outcomes."""
    seen, windows, out = set(), {}, []
    for r in rows:
        ids = [r[c] for c in ("tenant_id", "site_id", "aisle", "task_id")]
        if not all(ID.match(i) for i in ids) or not r["event_id"] or not r["run_id"]:
            out.append("invalid_id")
            continue
        s = r["seconds"]
        if math.isnan(s) or s <= 0 or s > 3600:
            out.append("invalid_duration")
            continue
        now, at = r["received_at"], r["observed_at"]
        if at > now + timedelta(minutes=1) or at < now - timedelta(minutes=5):
            out.append("stale_or_future")
            continue
        key = (r["tenant_id"], r["site_id"], r["aisle"])
        if key not in baselines:
            out.append("no_baseline")
            continue
        mean, stddev = baselines[key]
        window_key = (*key, r["workflow_id"], r["run_id"])
        values, last_alert, last_seen = windows.get(window_key, ([], None, None))
        if last_seen is not None and now - last_seen > config.idle_ttl:
            values, last_alert = [], None
        if (r["tenant_id"], r["event_id"]) in seen:
            out.append("duplicate")
            continue
        seen.add((r["tenant_id"], r["event_id"]))
        values = [*values, s][-config.window :]
        fired = False
        if len(values) == config.window and (
            last_alert is None or now - last_alert >= config.cooldown
        ):
            total = 0.0
            for v in values:
                total += v
            fired = total / len(values) >= mean + config.sigma * stddev
        windows[window_key] = (values, now if fired else last_alert, now)
        out.append("alert" if fired else "committed")
    return out
