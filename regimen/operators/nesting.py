"""Aggregation and nesting.

Nested results are returned *flat with positions*: one row per leaf with the
position of every enclosing level (``session_pos``, ``exercise_pos``, ...).
That is the nesting without building one array per owner, so no group is
ever collected into one row. ``nest_*`` helpers turn the flat form into
arrays for display; they collect one *day* or one *session* at a time, which
the plan bounds, never an owner's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimen.operators.ordinal import groups_bounded, hot_rows, join_null_safe, largest_sum, ordinal, proven_bounded, split_runs
from regimen.operators.outline import (day_exercise_rows, days_with_sessions, exercise_sets_of, open_workout_sets,
                                       requested_sessions, session_plan, track_levels, workout_details)
from regimen.sources.tables import Model


# --- D1-D3: counts and next ordinals ----------------------------------------------------

def count_days(m: Model) -> DataFrame:
    """Days per routine; routines without days count 0."""
    n = m.setup_days.groupBy(F.col("setup_routine_id").alias("routine_id")).agg(
        F.count(F.lit(1)).alias("total_days"))
    return (m.setup_routines.select(F.col("id").alias("routine_id"))
            .join(n, "routine_id", "left")
            .select("routine_id", F.coalesce("total_days", F.lit(0)).cast("long").alias("total_days")))


def next_by_max(children: DataFrame, parent: str, col: str, parents: DataFrame | None = None,
                name: str = "next_ordinal") -> DataFrame:
    """``COALESCE(MAX(col), 0) + 1`` per parent (parents without children get 1)."""
    agg = children.groupBy(parent).agg(F.max(col).alias("_mx"))
    base = agg if parents is None else parents.select(parent).join(agg, parent, "left")
    return base.select(parent, (F.coalesce("_mx", F.lit(0)) + 1).cast("int").alias(name))


def next_by_count(children: DataFrame, parent: str, col: str | None = None,
                  parents: DataFrame | None = None, name: str = "next_ordinal") -> DataFrame:
    """D3: ``COUNT(*) + 1`` (or ``COUNT(col) + 1``) per parent; differs from D2 on gaps."""
    counted = F.count(F.lit(1)) if col is None else F.count(col)
    agg = children.groupBy(parent).agg(counted.alias("_n"))
    base = agg if parents is None else parents.select(parent).join(agg, parent, "left")
    return base.select(parent, (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias(name))


# --- D4 / D5: day lists -----------------------------------------------------------------

def day_session_list(m: Model) -> DataFrame:
    """Each day -> its session names by slot; a day without session -> one NULL name."""
    rows = days_with_sessions(m)
    bounded = proven_bounded(rows.sparkSession, m.setup_days_sessions, ["day_id"])
    return (ordinal(rows, ["day_id"], [F.col("session_order").asc_nulls_last(),
                                       F.col("slot_id").asc_nulls_last()], "slot_pos", bounded=bounded)
            .select("routine_id", "day_id", "day_number", "slot_pos", "session_name"))


def nest_day_sessions(flat: DataFrame) -> DataFrame:
    """Display form of D4: one row per day with ``session_names`` in slot order.

    Structs are collected, not names: ``collect_list`` drops NULLs, and a day
    without a session must show ``[null]``. The flat list is the form for
    days of any size.
    """
    return (flat.groupBy("routine_id", "day_id", "day_number")
            .agg(F.sort_array(F.collect_list(F.struct("slot_pos", "session_name"))).alias("_s"))
            .select("routine_id", "day_id", "day_number",
                    F.transform("_s", lambda s: s["session_name"]).alias("session_names")))


def day_outline(m: Model) -> DataFrame:
    """Day -> sessions (merged by name, first slot wins) -> exercise names.

    Rows: routine_id, day_id, day_number, session_pos, session_name,
    exercise_pos, exercise_name. A rest day (or a session without exercises)
    has one row with NULL exercise; empty exercise names are skipped.
    """
    rows = day_exercise_rows(m)
    if day_rows_bound(m) <= hot_rows(rows.sparkSession):
        return _day_outline_one_pass(rows)
    # a hot day: every later group lies inside one day, all of them split
    bounded = False
    sessions = (rows.groupBy("routine_id", "day_id", "day_number", "session_name")
                .agg(F.min("session_order").alias("_first")))
    sessions = ordinal(sessions, ["day_id"], [F.col("_first").asc_nulls_last(),
                                              F.col("session_name").asc_nulls_last()], "session_pos",
                       bounded=bounded)
    named = rows.filter(F.col("exercise_name").isNotNull() & (F.col("exercise_name") != ""))
    ex = join_null_safe(named, sessions.select("day_id", "session_name", "session_pos"), ["day_id", "session_name"])
    ex = ordinal(ex, ["day_id", "session_pos"],
                 ["session_order", "exercise_order", "sse_id"], "exercise_pos", bounded=bounded)
    return (sessions.join(ex.select("day_id", "session_pos", "exercise_pos", "exercise_name"),
                          ["day_id", "session_pos"], "left")
            .select("routine_id", "day_id", "day_number", "session_pos", "session_name",
                    "exercise_pos", "exercise_name"))


def day_rows_bound(m: Model) -> int:
    """Outline rows of the largest day: the exercises of each session are counted where they lie and
    summed over the slots of each day."""
    n = m.setup_session_exercises.groupBy(F.col("setup_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    slots = m.setup_days_sessions.select("day_id", "session_id").join(n, "session_id", "left")
    return largest_sum(slots.withColumn("n", F.coalesce("n", F.lit(1))), ["day_id"])


def sets_of_sessions(m: Model, name: str) -> DataFrame:
    """(session_id, n): the sets below each session, counted where they lie."""
    return exercise_sets_of(m, name).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def _day_outline_one_pass(rows: DataFrame) -> DataFrame:
    """D5 when every day fits one task: one exchange on ``day_id`` serves all
    windows (hash partitioning on day_id clusters (day_id, session_name) too)."""
    named = F.col("exercise_name").isNotNull() & (F.col("exercise_name") != "")
    hit = F.when(named, 1).otherwise(0)
    by_name = Window.partitionBy("day_id", "session_name")
    in_session = by_name.orderBy("session_order", "exercise_order", "sse_id")
    by_day = Window.partitionBy("day_id").orderBy(F.col("_first").asc_nulls_last(),
                                                  F.col("session_name").asc_nulls_last())
    x = (rows.repartition("day_id")
         .withColumn("_first", F.min("session_order").over(by_name))
         .withColumn("_named", F.sum(hit).over(by_name))
         .withColumn("session_pos", F.dense_rank().over(by_day).cast("int"))
         .withColumn("_k", F.row_number().over(in_session))
         .withColumn("_e", F.sum(hit).over(in_session.rowsBetween(Window.unboundedPreceding,
                                                                   Window.currentRow))))
    keep = named | ((F.col("_named") == 0) & (F.col("_k") == 1))
    return x.filter(keep).select(
        "routine_id", "day_id", "day_number", "session_pos", "session_name",
        F.when(named, F.col("_e")).cast("int").alias("exercise_pos"),
        F.when(named, F.col("exercise_name")).alias("exercise_name"))


def nest_day_outline(flat: DataFrame) -> DataFrame:
    """Display form of D5: one row per day, ``sessions: array<struct<name, exercises>>``.

    Collects per session and then per day; both are bounded by the plan of one
    day. Use on a filtered result (one owner's page), not on a fact table; the
    flat outline is the form for days of any size.
    """
    per_session = (flat.groupBy("routine_id", "day_id", "day_number", "session_pos", "session_name")
                   .agg(F.sort_array(F.collect_list(F.when(F.col("exercise_pos").isNotNull(),
                        F.struct("exercise_pos", F.col("exercise_name").alias("name")))))
                        .alias("_ex")))
    per_session = per_session.withColumn("exercises", F.transform("_ex", lambda e: e["name"]))
    return (per_session.groupBy("routine_id", "day_id", "day_number")
            .agg(F.sort_array(F.collect_list(F.struct("session_pos",
                 F.col("session_name").alias("name"), "exercises"))).alias("_s"))
            .select("routine_id", "day_id", "day_number",
                    F.transform("_s", lambda s: F.struct(s["name"].alias("name"),
                                                         s["exercises"].alias("exercises")))
                    .alias("sessions")))


# --- D6 / D8: run grouping --------------------------------------------------------------

def runs(df: DataFrame, keys: Sequence[str], run_cols: Sequence[str], order: Sequence,
         run_name: str = "run_pos", item_name: str = "item_pos", bounded: bool | None = None) -> DataFrame:
    """Gaps and islands: a new run starts when any of ``run_cols`` changes
    between adjacent rows (by ``order``) of a ``keys`` group.

    Groups that fit one task are numbered in one window pass; otherwise a segmented scan over one range cut
    (``ordinal.split_runs``) does it, so a hot owner is split. NULL is a value like any other in keys and ``run_cols``.
    ``bounded``: the caller's proof from base tables; None measures ``df``.
    """
    keys, run_cols = list(keys), list(run_cols)
    if bounded is None:
        bounded = groups_bounded(df, keys)          # all groups below lie inside a keys group
    if bounded and hot_rows(df.sparkSession) > 0:
        return _runs_one_pass(df, keys, run_cols, order, run_name, item_name)
    return split_runs(df, keys, run_cols, order, run_name, item_name)


def _runs_one_pass(df: DataFrame, keys: list[str], run_cols: list[str], order: Sequence,
                   run_name: str, item_name: str) -> DataFrame:
    """Runs when every group fits one task: lag + running sum + row_number,
    all on one hash exchange of ``keys`` (it also clusters (keys, run))."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in run_cols:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    x = df.withColumn("_new", F.when(changed | F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(0))
    x = x.withColumn(run_name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding,
                                                                Window.currentRow)).cast("int"))
    return (x.withColumn(item_name, F.row_number().over(Window.partitionBy(*keys, run_name).orderBy(*order))
                         .cast("int"))
            .drop("_new"))


def nest_session_exercises(flat: DataFrame) -> DataFrame:
    """Display form of D6: one row per (user, session name) with
    ``exercises: array<struct<name, exercise_order, sets: array<struct>>>``.
    The flat rows are the form for sessions of any size."""
    keys = ["user_id", "session_name"]
    sets = (flat.groupBy(*keys, "exercise_pos", "exercise_name", "exercise_order")
            .agg(F.sort_array(F.collect_list(F.struct("set_pos", "cur_set", "reps_goal", "weight",
                                                      "reps_done"))).alias("sets")))
    return (sets.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("exercise_pos", F.col("exercise_name").alias("name"),
                                                      "exercise_order", "sets"))).alias("exercises")))


def open_session_exercises(m: Model) -> DataFrame:
    """D6 on C9: sets of open workouts grouped into exercises per (user, session name).

    A new exercise starts when the name or the order changes between adjacent
    rows ordered by (exercise order, set); two open snapshots of one session
    interleave, with session id and set id as tie-break.
    """
    rows = open_workout_sets(m)
    lv = track_levels(m)
    sessions = (lv["routines"].filter("in_progress").select("routine_id", "user_id")
                .join(lv["sessions"].withColumnRenamed("session_routine_id", "routine_id"), "routine_id"))
    counted = sessions.join(sets_of_sessions(m, "log_sets"), "session_id")
    bounded = largest_sum(counted, ["user_id", "session_name"]) <= hot_rows(rows.sparkSession)
    return runs(rows, ["user_id", "session_name"], ["exercise_name", "exercise_order"],
                ["exercise_order", "cur_set", "session_id", "set_id"],
                run_name="exercise_pos", item_name="set_pos", bounded=bounded)


def exercise_first_order(m: Model) -> DataFrame:
    """Distinct exercise names of each session with their first order number."""
    return (session_plan(m).groupBy("session_id", "name")
            .agg(F.min("order_number").alias("first_order")))


def plan_sets_by_order(m: Model) -> DataFrame:
    """Planned sets grouped under their exercise by order number (runs of order)."""
    bounded = largest_sum(sets_of_sessions(m, "plan_sets"), ["session_id"]) <= hot_rows(m.setup_sessions.sparkSession)
    return runs(session_plan(m), ["session_id"], ["order_number"], ["order_number", "set", "set_id"],
                run_name="exercise_pos", item_name="set_pos", bounded=bounded)


def workout_page(m: Model, requests: DataFrame) -> DataFrame:
    """D6 on C13: the exercises (with comment) and sets of requested workouts, by request."""
    rows = workout_details(m, requests)
    counted = requested_sessions(m, requests).join(sets_of_sessions(m, "log_sets"), "session_id")
    bounded = largest_sum(counted, ["request_id"]) <= hot_rows(rows.sparkSession)
    return runs(rows, ["request_id"], ["exercise_name", "exercise_order"], ["exercise_order", "cur_set", "set_id"],
                run_name="exercise_pos", item_name="set_pos", bounded=bounded)
