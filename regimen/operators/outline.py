"""Joins over the plan and the log (C1-C13), for every owner at once.

Each function returns flat rows keyed by the owner (user / routine), so a
single-user question is a filter on the result and the whole job partitions
by owner. Renames happen before each join, so no join needs column
disambiguation and Catalyst can prune every scan to the columns used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.sources.tables import Model


def _r(df: DataFrame, **names: str) -> DataFrame:
    """Select and rename: ``_r(df, new=old, ...)``."""
    return df.selectExpr(*[f"`{old}` AS `{new}`" for new, old in names.items()])


# --- building blocks: each level renamed to unambiguous columns -----------------------

class Levels(dict):
    """The renamed levels of one hierarchy, each made when it is first asked for."""

    def __init__(self, m: Model, spec: dict[str, tuple[str, dict[str, str]]]):
        super().__init__()
        self.m, self.spec = m, spec

    def __missing__(self, level: str) -> DataFrame:
        table, names = self.spec[level]
        self[level] = _r(self.m[table], **names)
        return self[level]


_PLAN = dict(
    routines=("setup_routines", dict(routine_id="id", routine_name="name", user_id="user_id", routine_created="routine_created")),
    days=("setup_days", dict(day_id="id", day_number="day_number", routine_id="setup_routine_id")),
    slots=("setup_days_sessions", dict(slot_id="id", day_id="day_id", session_id="session_id", session_order="session_order")),
    sessions=("setup_sessions", dict(session_id="id", session_name="name", session_routine_id="setup_routine_id")),
    exercises=("setup_session_exercises", dict(sse_id="id", session_id="setup_session_id", exercise_id="exercise_id",
                                               custom_exercise_id="custom_exercise_id", exercise_order="exercise_order",
                                               exercise_comment="exercise_comment")),
    sets=("setup_exercise_details", dict(set_id="id", sse_id="setup_session_exercise_id", weight="weight", cur_set="cur_set",
                                         reps_goal="reps_goal", myo_order="myo_order")))

_LOG = dict(
    routines=("track_routines", dict(routine_id="id", routine_name="name", user_id="user_id", in_progress="in_progress",
                                     completion_date="completion_date", routine_setup_id="setup_id")),
    days=("track_days", dict(day_id="id", day_number="day_number", routine_id="track_routine_id")),
    slots=("track_days_sessions", dict(slot_id="id", day_id="day_id", session_id="session_id", session_order="session_order")),
    sessions=("track_sessions", dict(session_id="id", session_name="name", session_routine_id="track_routine_id")),
    exercises=("track_session_exercises", dict(sse_id="id", session_id="track_session_id", exercise_id="exercise_id",
                                               custom_exercise_id="custom_exercise_id", exercise_order="exercise_order",
                                               exercise_comment="exercise_comment")),
    sets=("track_exercise_details", dict(set_id="id", sse_id="track_session_exercise_id", weight="weight", cur_set="cur_set",
                                         reps_goal="reps_goal", reps_done="reps_done", myo_order="myo_order")))


def setup_levels(m: Model) -> Levels:
    return Levels(m, _PLAN)


def track_levels(m: Model) -> Levels:
    return Levels(m, _LOG)


def exercise_sets_of(m: Model, name: str) -> DataFrame:
    """Exercises joined with their sets (``plan_sets`` or ``log_sets``), with the columns of the two levels: as the
    source has them ready, or by the join."""
    ready, spec = m.joined(name), _PLAN if name == "plan_sets" else _LOG
    if ready is None:
        lv = Levels(m, spec)
        return lv["exercises"].join(lv["sets"], "sse_id")
    return ready.select(*{c: None for level in ("exercises", "sets") for c in spec[level][1]})


def custom_names(m: Model) -> DataFrame:
    return _r(m.custom_exercises, custom_exercise_id="id", exercise_name="name")


def catalog_names(m: Model) -> DataFrame:
    return _r(m.exercises, exercise_id="id", exercise_name="name")


def users(m: Model) -> DataFrame:
    return _r(m.users, user_id="id", username="username")


# --- C1 / C2: full outlines -----------------------------------------------------------

OUTLINE_COLUMNS = ["user_id", "user", "routine_id", "routine_name", "day_number", "session_name",
                   "session_order", "exercise_name", "exercise_order", "cur_set"]


def _outline(m: Model, lv: Levels, sets: str) -> DataFrame:
    u = _r(m.users, user_id="id", user="username")
    return (u.join(lv["routines"], "user_id")
            .join(lv["days"], "routine_id")
            .join(lv["slots"], "day_id")
            .join(lv["sessions"], "session_id")
            .join(exercise_sets_of(m, sets), "session_id")
            .join(catalog_names(m), "exercise_id")
            .select(*OUTLINE_COLUMNS))


def plan_outline(m: Model) -> DataFrame:
    """User -> routine -> day -> slot -> session -> exercise -> set (inner joins)."""
    return _outline(m, setup_levels(m), "plan_sets")


def log_outline(m: Model) -> DataFrame:
    """The same over the log tables."""
    return _outline(m, track_levels(m), "log_sets")


def sort_outline(df: DataFrame) -> DataFrame:
    """F1 for outlines: owner first, then the reference's 4 keys, NULLs last."""
    keys = ["user_id", "routine_id", "day_number", "session_order", "exercise_order", "cur_set"]
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys if k in df.columns])


# --- C3 / C4: day lists with rest days kept ------------------------------------------

def _day_slots(m: Model) -> DataFrame:
    lv = setup_levels(m)
    return (lv["days"].join(lv["slots"], "day_id", "left")
            .join(lv["sessions"].select("session_id", "session_name"), "session_id", "left"))


def days_with_sessions(m: Model) -> DataFrame:
    """Every day with the names of its sessions; a day without session keeps one row."""
    return _day_slots(m).select("routine_id", "day_id", "day_number", "slot_id", "session_order",
                                "session_name")


def day_exercise_rows(m: Model) -> DataFrame:
    """C4: days -> sessions -> exercise names, all left joins (rest days kept)."""
    lv = setup_levels(m)
    return (_day_slots(m)
            .join(lv["exercises"].select("sse_id", "session_id", "custom_exercise_id",
                                         "exercise_order"), "session_id", "left")
            .join(custom_names(m), "custom_exercise_id", "left")
            .select("routine_id", "day_id", "day_number", "slot_id", "session_order",
                    "session_name", "sse_id", "exercise_order", "exercise_name"))


# --- C5 / C6 / C11: cursor questions --------------------------------------------------

def current_routine_name(m: Model) -> DataFrame:
    """Each user's current routine (NULL when none is selected)."""
    cur = _r(m.users_current_details, user_id="user_id", routine_id="current_routine_id")
    r = _r(m.setup_routines, routine_id="id", routine_name="name")
    return (users(m).join(cur, "user_id", "left").join(r, "routine_id", "left")
            .select("user_id", "routine_id", "routine_name"))


def slot_sessions(m: Model) -> DataFrame:
    """Session name at each (routine, day number, slot)."""
    lv = setup_levels(m)
    return (lv["slots"].join(lv["days"], "day_id")
            .join(lv["sessions"].select("session_id", "session_name"), "session_id")
            .select("routine_id", "day_number", "session_order", "session_id", "session_name"))


def active_slots(m: Model) -> DataFrame:
    """C11 (positive side): (routine, day, slot) having an exercise with order 1.

    A slot is a rest slot when it is absent here. The semi join and the unique
    keys (routine, day number) and (day, slot) leave one row per slot.
    """
    lv = setup_levels(m)
    first = lv["exercises"].filter(F.col("exercise_order") == 1).select("session_id")
    return (lv["slots"].join(first, "session_id", "left_semi")
            .join(lv["days"], "day_id")
            .select("routine_id", "day_number", "session_order"))


def rest_flags(m: Model, cursors: DataFrame) -> DataFrame:
    """C11: ``is_rest`` for each (routine_id, day_number, session_order) request row."""
    keys = ["routine_id", "day_number", "session_order"]
    hit = active_slots(m).join(cursors.select(*keys), keys, "left_semi").distinct().withColumn("_active", F.lit(True))   # asked slots, each once
    return cursors.join(hit, keys, "left").withColumn("is_rest", F.col("_active").isNull()).drop("_active")


# --- C7 / C8: plan of a session ------------------------------------------------------

def session_plan(m: Model) -> DataFrame:
    """Exercises and planned sets of every session (inner joins)."""
    return (exercise_sets_of(m, "plan_sets").join(custom_names(m), "custom_exercise_id")
            .select("session_id", "sse_id", "set_id", F.col("exercise_name").alias("name"),
                    F.col("exercise_order").alias("order_number"), F.col("cur_set").alias("set"),
                    F.col("reps_goal").alias("reps")))


def exercise_sets(m: Model) -> DataFrame:
    """Sets of each session exercise, keyed by the session exercise."""
    return _r(m.setup_exercise_details, sse_id="setup_session_exercise_id", set_id="id",
              set="cur_set", reps="reps_goal")


# --- C9 / C10: open workouts ----------------------------------------------------------

def open_workout_sets(m: Model) -> DataFrame:
    """Logged sets of in-progress workouts with exercise names (5 tables)."""
    lv = track_levels(m)
    return (lv["routines"].filter(F.col("in_progress"))
            .select("routine_id", "user_id")
            .join(lv["sessions"].withColumnRenamed("session_routine_id", "routine_id"), "routine_id")
            .join(exercise_sets_of(m, "log_sets"), "session_id")
            .join(custom_names(m), "custom_exercise_id")
            .select("user_id", "routine_id", "session_id", "session_name", "sse_id", "set_id",
                    "exercise_name", "exercise_order", "cur_set", "reps_goal", "weight",
                    "reps_done", "exercise_comment"))


def active_sessions(m: Model) -> DataFrame:
    """Open session id per (user, day number, session name)."""
    lv = track_levels(m)
    return (lv["routines"].filter(F.col("in_progress")).select("routine_id", "user_id")
            .join(lv["days"], "routine_id")
            .join(lv["slots"], "day_id")
            .join(lv["sessions"].select("session_id", "session_name"), "session_id")
            .select("user_id", "routine_id", "day_number", "session_order", "session_name",
                    "session_id"))


# --- C12 / C13: history ---------------------------------------------------------------

def completed_workouts(m: Model) -> DataFrame:
    """Completed workouts with day and session (4 tables)."""
    lv = track_levels(m)
    return (lv["routines"].filter(~F.col("in_progress"))
            .select("routine_id", "user_id", "routine_name", "completion_date")
            .join(lv["days"], "routine_id")
            .join(lv["slots"], "day_id")
            .join(lv["sessions"].select("session_id", "session_name"), "session_id")
            .select("user_id", "routine_id", "completion_date", "routine_name", "day_number",
                    "session_name"))


def second(ts: Column) -> Column:
    """Truncate an instant to the second (NTZ input read as UTC)."""
    return F.date_trunc("second", ts.cast("timestamp"))


def requested_sessions(m: Model, requests: DataFrame) -> DataFrame:
    """The logged sessions of the requested workouts: request_id, user_id, routine_id, session_id, session_name."""
    lv = track_levels(m)
    # one row per logged session first: these narrow levels share the workout's key, so a source that deals
    # them by it joins them in place; only requests and the sessions that they name meet by shuffle
    sessions = (lv["routines"].select("routine_id", "user_id", "routine_name", second(F.col("completion_date")).alias("_sec"))
                .join(lv["days"], "routine_id")
                .join(lv["slots"].select("day_id", "session_id"), "day_id")
                .join(lv["sessions"].select("session_id", "session_name"), "session_id"))
    req = requests.select("request_id", "user_id", "routine_name", second(F.col("completion_date")).alias("_sec"), "day_number", "session_name")
    return (req.join(sessions, ["user_id", "routine_name", "_sec", "day_number", "session_name"])
            .select("request_id", "user_id", "routine_id", "session_id", "session_name"))


def workout_details(m: Model, requests: DataFrame) -> DataFrame:
    """Detail rows of requested workouts (7 tables).

    ``requests``: request_id, user_id, routine_name, completion_date,
    day_number, session_name. The date matches at second precision (B16).
    """
    return (requested_sessions(m, requests)
            .join(exercise_sets_of(m, "log_sets"), "session_id")
            .join(custom_names(m), "custom_exercise_id")
            .select("request_id", "user_id", "routine_id", "session_id", "session_name", "sse_id",
                    "set_id", "exercise_name", "exercise_order", "cur_set", "reps_goal", "weight",
                    "reps_done", "exercise_comment"))
