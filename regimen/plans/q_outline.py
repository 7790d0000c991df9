"""Registered queries: plan and log outlines (C1-C13) and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimen.operators import nesting as D
from regimen.operators import outline as C
from regimen.plans.registry import query
from regimen.sources.adapter import from_driver

_OUTLINE_SQL = """
SELECT c_custkey AS user_id, c_name AS "user", routine_id, 'Plan ' || CAST(c_custkey AS VARCHAR) AS routine_name,
       day_number, session_name, session_order, exercise_name, exercise_order, cur_set
FROM {days} JOIN customer ON c_custkey = {owner} JOIN part_sets USING (session_id) WHERE exercise_name IS NOT NULL
"""
_PLAN_OUTLINE = _OUTLINE_SQL.format(days="plan_days", owner="routine_id")
_LOG_OUTLINE = _OUTLINE_SQL.format(days="(SELECT *, workout_id AS routine_id, 1 AS session_order FROM log_days) x", owner="user_id")


@query("c1_plan_outline", _PLAN_OUTLINE, dense=True)
def c1_plan_outline(spark, sf, model=from_driver):
    return C.plan_outline(model(spark, sf))


@query("c2_log_outline", _LOG_OUTLINE, dense=True)
def c2_log_outline(spark, sf, model=from_driver):
    return C.log_outline(model(spark, sf))


@query("c3_days_with_sessions", """
SELECT routine_id, day_number, session_order, session_name FROM plan_days""", dense=True)
def c3_days_with_sessions(spark, sf, model=from_driver):
    return C.days_with_sessions(model(spark, sf)).select(
        "routine_id", "day_number", "session_order", "session_name")


@query("c4_day_exercise_rows", """
SELECT routine_id, day_number, session_order, session_name, exercise_order, exercise_name
FROM plan_days LEFT JOIN part_lines USING (session_id)""", dense=True)
def c4_day_exercise_rows(spark, sf, model=from_driver):
    return C.day_exercise_rows(model(spark, sf)).select(
        "routine_id", "day_number", "session_order", "session_name", "exercise_order",
        "exercise_name")


@query("c5_current_routine_name", """
SELECT u.id AS user_id, r.id AS routine_id, r.name AS routine_name
FROM users u
LEFT JOIN users_current_details c ON u.id = c.user_id
LEFT JOIN setup_routines r ON c.current_routine_id = r.id""")
def c5_current_routine_name(spark, sf):
    return C.current_routine_name(from_driver(spark, sf))


@query("c6_slot_sessions", """
SELECT routine_id, day_number, session_order, session_name FROM plan_days WHERE session_id IS NOT NULL""", dense=True)
def c6_slot_sessions(spark, sf, model=from_driver):
    return C.slot_sessions(model(spark, sf)).drop("session_id")


@query("c7_session_plan", """
SELECT session_id, exercise_name AS name, exercise_order AS order_number, cur_set AS "set", reps_goal AS reps
FROM part_sets WHERE exercise_name IS NOT NULL""", dense=True)
def c7_session_plan(spark, sf, model=from_driver):
    return C.session_plan(model(spark, sf)).drop("sse_id", "set_id")


@query("c8_exercise_sets", 'SELECT sse_id, cur_set AS "set", reps_goal AS reps FROM part_sets', dense=True)
def c8_exercise_sets(spark, sf, model=from_driver):
    return C.exercise_sets(model(spark, sf)).drop("set_id")


_OPEN_SETS_SQL = """
open_sets AS (
  SELECT user_id, session_id, session_name, set_id, exercise_name, exercise_order, cur_set, reps_goal, weight,
         reps_done, comment AS exercise_comment
  FROM log_days JOIN part_sets USING (session_id) WHERE is_open AND exercise_name IS NOT NULL)
"""


@query("c9_open_workout_sets", _OPEN_SETS_SQL + """
SELECT user_id, session_name, exercise_name, exercise_order, cur_set, reps_goal, weight,
       reps_done, exercise_comment
FROM open_sets""", dense=True)
def c9_open_workout_sets(spark, sf, model=from_driver):
    return C.open_workout_sets(model(spark, sf)).select(
        "user_id", "session_name", "exercise_name", "exercise_order", "cur_set", "reps_goal",
        F.col("weight").cast("double"), "reps_done", "exercise_comment")


@query("c10_active_sessions", "SELECT user_id, day_number, session_name, session_id FROM log_days WHERE is_open", dense=True)
def c10_active_sessions(spark, sf, model=from_driver):
    return C.active_sessions(model(spark, sf)).select(
        "user_id", "day_number", "session_name", "session_id")


_ACTIVE_SQL = """
active AS (
  SELECT routine_id, day_number, session_order FROM plan_days
  WHERE session_id IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 1))
"""


@query("c11_rest_flags", _ACTIVE_SQL + """,
cursors AS (
  SELECT current_routine_id AS routine_id, current_day_number AS day_number,
         current_session_number AS session_order
  FROM users_current_details WHERE current_routine_id IS NOT NULL)
SELECT c.routine_id, c.day_number, c.session_order, a.routine_id IS NULL AS is_rest
FROM cursors c LEFT JOIN active a
  ON c.routine_id = a.routine_id AND c.day_number = a.day_number
 AND c.session_order = a.session_order""")
def c11_rest_flags(spark, sf):
    m = from_driver(spark, sf)
    cursors = (m.users_current_details.filter(F.col("current_routine_id").isNotNull())
               .select(F.col("current_routine_id").alias("routine_id"),
                       F.col("current_day_number").alias("day_number"),
                       F.col("current_session_number").alias("session_order")))
    return C.rest_flags(m, cursors)


COMPLETED_SQL = """
completed AS (
  SELECT user_id, workout_id AS routine_id, completion_date, workout_name AS routine_name, day_number, session_name
  FROM log_days WHERE NOT is_open)
"""


@query("c12_completed_workouts", COMPLETED_SQL + """
SELECT user_id, completion_date, routine_name, day_number, session_name FROM completed""", dense=True)
def c12_completed_workouts(spark, sf, model=from_driver):
    return (C.completed_workouts(model(spark, sf))
            .withColumn("completion_date", F.col("completion_date").cast("timestamp_ntz"))
            .select("user_id", "completion_date", "routine_name", "day_number", "session_name"))


@query("c13_workout_details", """
same AS (
  SELECT a.workout_id AS request_id, b.session_id
  FROM log_days a JOIN log_days b USING (user_id, workout_name, day_number, session_name)
  WHERE NOT a.is_open AND date_trunc('second', a.completion_date) = date_trunc('second', b.completion_date))
SELECT request_id, exercise_name, exercise_order, cur_set, reps_goal, weight, reps_done
FROM same JOIN part_sets USING (session_id) WHERE exercise_name IS NOT NULL""", dense=True)
def c13_workout_details(spark, sf, model=from_driver):
    """Detail of every completed workout (the request batch is the whole history)."""
    m = model(spark, sf)
    req = C.completed_workouts(m).withColumnRenamed("routine_id", "request_id")
    return C.workout_details(m, req).select(
        "request_id", "exercise_name", "exercise_order", "cur_set", "reps_goal",
        F.col("weight").cast("double"),
        "reps_done")


@query("d1_count_days", """
SELECT id AS routine_id, CAST(coalesce(n, 0) AS BIGINT) AS total_days
FROM setup_routines LEFT JOIN (SELECT routine_id AS id, count(DISTINCT day_id) AS n FROM plan_days GROUP BY 1) d USING (id)""", dense=True)
def d1_count_days(spark, sf, model=from_driver):
    return D.count_days(model(spark, sf))


@query("d2_next_exercise_order", """
SELECT s.id AS setup_session_id, CAST(coalesce(max(x.exercise_order), 0) + 1 AS INTEGER)
       AS next_ordinal
FROM setup_sessions s LEFT JOIN setup_session_exercises x ON x.setup_session_id = s.id
GROUP BY s.id""")
def d2_next_exercise_order(spark, sf):
    m = from_driver(spark, sf)
    return D.next_by_max(m.setup_session_exercises, "setup_session_id", "exercise_order",
                         parents=m.setup_sessions.select(F.col("id").alias("setup_session_id")))


@query("d3_next_set_number", """
SELECT x.id AS track_session_exercise_id, CAST(count(t.cur_set) + 1 AS INTEGER) AS next_ordinal
FROM track_session_exercises x
LEFT JOIN track_exercise_details t ON t.track_session_exercise_id = x.id
GROUP BY x.id""")
def d3_next_set_number(spark, sf):
    m = from_driver(spark, sf)
    return D.next_by_count(m.track_exercise_details, "track_session_exercise_id", "cur_set",
                           parents=m.track_session_exercises.select(
                               F.col("id").alias("track_session_exercise_id")))


@query("d4_day_session_list", """
SELECT routine_id, day_number,
       CAST(row_number() OVER (PARTITION BY day_id ORDER BY session_order NULLS LAST,
                               slot_id NULLS LAST) AS INTEGER) AS slot_pos,
       session_name
FROM plan_days""", dense=True)
def d4_day_session_list(spark, sf, model=from_driver):
    return D.day_session_list(model(spark, sf)).drop("day_id")


_D5_SQL = """
outline AS (SELECT * FROM plan_days LEFT JOIN part_lines USING (session_id)),
blocks AS (
  SELECT routine_id, day_id, day_number, session_name,
         CAST(dense_rank() OVER (PARTITION BY day_id ORDER BY min(session_order) NULLS LAST, session_name NULLS LAST) AS INTEGER) AS session_pos
  FROM outline GROUP BY routine_id, day_id, day_number, session_name),
named AS (
  SELECT day_id, session_pos, exercise_name,
         CAST(row_number() OVER (PARTITION BY day_id, session_pos ORDER BY session_order, exercise_order, sse_id) AS INTEGER) AS exercise_pos
  FROM outline JOIN blocks b USING (day_id) WHERE exercise_name <> '' AND outline.session_name IS NOT DISTINCT FROM b.session_name)
SELECT routine_id, day_number, session_pos, session_name, exercise_pos, exercise_name
FROM blocks LEFT JOIN named USING (day_id, session_pos)
"""


@query("d5_day_outline", _D5_SQL, dense=True)
def d5_day_outline(spark, sf, model=from_driver):
    return D.day_outline(model(spark, sf)).drop("day_id")


@query("d6_open_session_exercises", _OPEN_SETS_SQL + """,
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, session_name
                               ORDER BY exercise_order, cur_set, session_id, set_id) AS pos
  FROM open_sets),
flagged AS (
  SELECT *, CASE WHEN lag(exercise_name) OVER w IS DISTINCT FROM exercise_name
                   OR lag(exercise_order) OVER w IS DISTINCT FROM exercise_order
                 THEN 1 ELSE 0 END AS new_run
  FROM ordered WINDOW w AS (PARTITION BY user_id, session_name ORDER BY pos)),
numbered AS (
  SELECT *, sum(new_run) OVER (PARTITION BY user_id, session_name ORDER BY pos) AS run
  FROM flagged)
SELECT user_id, session_name, CAST(run AS INTEGER) AS exercise_pos, exercise_name, exercise_order,
       CAST(row_number() OVER (PARTITION BY user_id, session_name, run ORDER BY pos) AS INTEGER)
         AS set_pos,
       cur_set, reps_goal, weight, reps_done, exercise_comment
FROM numbered""", dense=True)
def d6_open_session_exercises(spark, sf, model=from_driver):
    return D.open_session_exercises(model(spark, sf)).select(
        "user_id", "session_name", "exercise_pos", "exercise_name", "exercise_order", "set_pos",
        "cur_set", "reps_goal", F.col("weight").cast("double"), "reps_done", "exercise_comment")


@query("d7_exercise_first_order", """
SELECT session_id, exercise_name AS name, min(exercise_order) AS first_order
FROM part_sets WHERE exercise_name IS NOT NULL GROUP BY session_id, exercise_name""", dense=True)
def d7_exercise_first_order(spark, sf, model=from_driver):
    return D.exercise_first_order(model(spark, sf))


@query("d8_plan_sets_by_order", """
flagged AS (
  SELECT *, CASE WHEN lag(exercise_order) OVER w IS DISTINCT FROM exercise_order THEN 1 ELSE 0 END AS fresh,
         row_number() OVER w AS pos
  FROM part_sets WHERE exercise_name IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY exercise_order, cur_set, set_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM flagged)
SELECT session_id, CAST(run AS INTEGER) AS exercise_pos, exercise_order AS order_number, exercise_name AS name,
       CAST(row_number() OVER (PARTITION BY session_id, run ORDER BY pos) AS INTEGER) AS set_pos, cur_set AS "set", reps_goal AS reps
FROM numbered""", dense=True)
def d8_plan_sets_by_order(spark, sf, model=from_driver):
    return D.plan_sets_by_order(model(spark, sf)).select(
        "session_id", "exercise_pos", "order_number", "name", "set_pos", "set", "reps")
