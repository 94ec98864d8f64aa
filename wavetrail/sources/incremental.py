"""The detector over a growing log: one slice of arrivals after another."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavetrail.operators import detector as d
from wavetrail.session import written
from wavetrail.sources.sinks import append_windows, stored_log


def run_slice(
    observations: DataFrame, baselines: DataFrame, config: d.DetectorConfig, path: str
) -> DataFrame:
    """Detect congestion in the next slice of arrivals and append it to the log at `path`.

    Returns the alerts of the slice. Windows, sessions and cooldowns go on from the log, whose
    reading is limited to the window keys of the slice. Slices come in arrival order; one that is
    given again finds its events stored and changes nothing.
    """
    stored = stored_log(observations.sparkSession, path)
    state = None
    if stored is not None:
        keys = d.gate_observations(observations)
        state = written(d.window_state(d.state_of_keys(stored, keys), config), "state")
    # written tables: a checkpoint computes its rows twice, and later steps read only the columns they use
    rolled = written(d.committed_windows(observations, baselines, config, stored, state), "rolled")
    alerts = written(d.alerts_of_windows(rolled, config, state), "alerts")
    append_windows(rolled, alerts, path)
    return alerts
