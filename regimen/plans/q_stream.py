"""Registered queries: the set-log stream (K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimen.plans import q_transform as T
from regimen.plans import requests as R
from regimen.plans.registry import query
from regimen.session import checkpoint_dir
from regimen.sources.adapter import from_driver
from regimen.sources.levels import stored
from regimen.streaming import setlog as K

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def streamed_events(spark, m, path: str, base: str, files_per_trigger: int | None = None):
    """The events files as a stream of set logs."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("basePath", base)      # a glob over files inside a folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    checkpoint_dir(spark)
    counts, days = (stored(t, "set-log-lookup") for t in R.set_log_lookup(m))    # once per run, not per batch
    return R.as_set_logs(reader.parquet(path), counts, days)


def _run(spark, sf):
    m = from_driver(spark, sf)
    return m, K.run_set_log_stream(m, streamed_events(spark, m, f"{sf}/events*.parquet", sf))


@query("k1_set_log_stream", T._SET_LOG + "," + T._TARGETS)
def k1_set_log_stream(spark, sf):
    """Stream the events table through K1; the final log state equals I8."""
    m, root = _run(spark, sf)
    state = K.apply_state(m, K.current_state(spark, root))
    return state.select("id", F.col("weight").cast("double"), "reps_done")


@query("k1_set_log_quarantine", T._SET_LOG + "SELECT event_id, problem FROM checked WHERE problem IS NOT NULL")
def k1_set_log_quarantine(spark, sf):
    """The stream's refused set logs, each with its reason (= J12)."""
    _, root = _run(spark, sf)
    return K.set_log(spark, root).filter("outcome = 'refused'").select("event_id", "problem")


@query("k1_set_log_outcomes", T._SET_LOG + "," + T._TARGETS[:T._TARGETS.index("last AS")].rstrip().rstrip(",") + """
SELECT c.event_id, CASE WHEN c.problem IS NOT NULL THEN 'refused'
                        WHEN h.event_id IS NULL THEN 'unresolved' ELSE 'update' END AS outcome
FROM checked c LEFT JOIN hit h ON h.event_id = c.event_id""")
def k1_set_log_outcomes(spark, sf):
    """Every set log has one outcome: accepted ones are updates or unresolved."""
    _, root = _run(spark, sf)
    return K.set_log(spark, root).select("event_id", "outcome")


@query("k1_late_workouts", T._SET_LOG + "," + T._TARGETS)
def k1_late_workouts(spark, sf):
    """The logs come first: a run without the workouts of keys % 3 = 0 and 1, then one without those of % 3 = 0, then
    one with all, over the same events. Every value arrives; the final log state equals I8."""
    m = from_driver(spark, sf)
    logs = streamed_events(spark, m, f"{sf}/events*.parquet", sf)
    root = None
    for least in (2, 1, 0):
        opened = m.replace(track_routines=m.track_routines.filter(F.col("id") % 3 >= least))
        root = K.run_set_log_stream(opened, logs, root)
    state = K.apply_state(m, K.current_state(spark, root))
    return state.select("id", F.col("weight").cast("double"), "reps_done")
