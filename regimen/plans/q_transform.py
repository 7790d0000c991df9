"""Registered queries: the day cursor and table transforms."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.operators import transform as I
from regimen.plans import requests as R
from regimen.plans.registry import query
from regimen.sources.adapter import from_driver

RUN, AS_OF = R.RUN, R.AS_OF

_ACTIVE = """
active AS (
  SELECT DISTINCT d.setup_routine_id AS routine_id, d.day_number, ds.session_order
  FROM setup_days d
  JOIN setup_days_sessions ds ON d.id = ds.day_id
  JOIN setup_session_exercises x ON ds.session_id = x.setup_session_id
  WHERE x.exercise_order = 1),
ndays AS (SELECT setup_routine_id AS routine_id, count(*) AS total_days FROM setup_days GROUP BY 1),
reach AS (
  SELECT a.* FROM active a JOIN ndays n ON a.routine_id = n.routine_id
  WHERE a.day_number <= n.total_days),
cur AS (
  SELECT user_id, current_routine_id AS routine_id, current_day_number AS day_number,
         current_session_number AS session_order
  FROM users_current_details WHERE current_routine_id IS NOT NULL),
nxt AS (
  SELECT c.user_id, c.routine_id, c.day_number AS cursor_day, c.session_order,
         CAST(coalesce(
           (SELECT min(a.day_number) FROM active a WHERE a.routine_id = c.routine_id
              AND a.session_order = c.session_order AND a.day_number = c.day_number),
           (SELECT min(a.day_number) FROM reach a WHERE a.routine_id = c.routine_id
              AND a.session_order = c.session_order AND a.day_number > c.day_number),
           (SELECT min(a.day_number) FROM reach a WHERE a.routine_id = c.routine_id
              AND a.session_order = c.session_order)) AS INTEGER) AS day_number
  FROM cur c),
slot_names AS (
  SELECT d.setup_routine_id AS routine_id, d.day_number, ds.session_order, s.name AS session_name
  FROM setup_days_sessions ds JOIN setup_days d ON ds.day_id = d.id
  JOIN setup_sessions s ON ds.session_id = s.id),
whats_next AS (
  SELECT n.user_id, n.routine_id, r.name AS routine_name, n.day_number, sn.session_name
  FROM nxt n LEFT JOIN setup_routines r ON r.id = n.routine_id
  LEFT JOIN slot_names sn ON sn.routine_id = n.routine_id AND sn.day_number = n.day_number
   AND sn.session_order = n.session_order)
"""

_DAY_SESSION = """
day_session AS (
  SELECT d.setup_routine_id AS routine_id, d.day_number, s.id AS session_id, s.name AS session_name
  FROM setup_days d JOIN setup_days_sessions ds ON ds.day_id = d.id AND ds.session_order = 1
  JOIN setup_sessions s ON s.id = ds.session_id)
"""


def _h(entity: str, *parts: str) -> str:
    """DuckDB form of ``det_id``."""
    cols = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"sha256(concat_ws('|', '{RUN}', '{entity}', {cols}))"


@query("i16_next_training_day", _ACTIVE + """
SELECT user_id, routine_id, cursor_day, day_number, session_order FROM nxt""")
def i16_next_training_day(spark, sf):
    return I.next_training_day(from_driver(spark, sf))


@query("e1_whats_next", _ACTIVE + "SELECT * FROM whats_next")
def e1_whats_next(spark, sf):
    """Flow E1: what does every user train next (I16 + C5 + C6)."""
    return I.whats_next(from_driver(spark, sf))


@query("i21_read_cursor", """
SELECT user_id, current_routine_id AS routine_id, current_day_number AS day_number,
       current_session_number AS session_number FROM users_current_details""")
def i21_read_cursor(spark, sf):
    return I.read_cursor(from_driver(spark, sf))


@query("i15_advance_cursor", """
req AS (SELECT user_id, current_routine_id AS routine_id FROM users_current_details
        WHERE current_routine_id IS NOT NULL),
ndays AS (SELECT setup_routine_id AS routine_id, count(*) AS total_days FROM setup_days GROUP BY 1)
SELECT u.user_id, u.current_routine_id,
       CAST(CASE WHEN q.user_id IS NOT NULL THEN
              CASE WHEN u.current_day_number < n.total_days THEN u.current_day_number + 1 ELSE 1 END
            ELSE u.current_day_number END AS INTEGER) AS current_day_number,
       u.current_session_number
FROM users_current_details u
LEFT JOIN req q ON q.user_id = u.user_id AND q.routine_id = u.current_routine_id
LEFT JOIN ndays n ON n.routine_id = u.current_routine_id""")
def i15_advance_cursor(spark, sf):
    """Every user with a current routine moves one day on."""
    m = from_driver(spark, sf)
    req = I.read_cursor(m).filter(F.col("routine_id").isNotNull()).select("user_id", "routine_id")
    return I.advance_cursor(m, req)


@query("i17_select_routine", """
req AS (SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 7 = 0 THEN lower('Plan ' || CAST(c_custkey AS VARCHAR))
                    ELSE 'Plan ' || CAST(c_custkey AS VARCHAR) END AS routine_name FROM customer),
res AS (SELECT q.user_id, r.id AS new_id FROM req q
        JOIN setup_routines r ON r.user_id = q.user_id AND r.name = q.routine_name)
SELECT u.user_id,
       CASE WHEN ch THEN s.new_id ELSE u.current_routine_id END AS current_routine_id,
       CAST(CASE WHEN ch THEN 1 ELSE u.current_day_number END AS INTEGER) AS current_day_number,
       CAST(CASE WHEN ch THEN 1 ELSE u.current_session_number END AS INTEGER) AS current_session_number
FROM (SELECT u.*, s.new_id,
             s.new_id IS NOT NULL AND (u.current_routine_id IS NULL OR u.current_routine_id <> s.new_id) AS ch
      FROM users_current_details u LEFT JOIN res s ON s.user_id = u.user_id) u
LEFT JOIN res s ON s.user_id = u.user_id""")
def i17_select_routine(spark, sf):
    return I.select_routine(from_driver(spark, sf), R.select_routine_requests(spark, sf))


def _snapshot_rows(new: dict[str, DataFrame]) -> DataFrame:
    def pick(t, entity, parent, other, ordinal):
        df = new[t]
        return df.select(F.lit(entity).alias("entity"), F.col("id").cast("string").alias("id"),
                         (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent_id"),
                         F.col(other).cast("string").alias("other_id"),
                         (F.col(ordinal).cast("int") if ordinal else F.lit(None).cast("int")).alias("ord"))
    parts = [pick("track_routines", "routine", None, "setup_id", None),
             pick("track_days", "day", "track_routine_id", "setup_id", "day_number"),
             pick("track_sessions", "session", "track_routine_id", "setup_id", None),
             pick("track_days_sessions", "slot", "day_id", "session_id", "session_order"),
             pick("track_session_exercises", "exercise", "track_session_id", "setup_id", "exercise_order"),
             pick("track_exercise_details", "set", "track_session_exercise_id", "setup_id", "cur_set")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _snapshot_sql(req_cte: str, day_filter: bool) -> str:
    dj = "AND d.day_number = q.day_number" if day_filter else ""
    sj = "AND s.name = q.session_name" if day_filter else ""
    return req_cte + f""",
r AS (SELECT q.*, sr.id AS src FROM req q JOIN setup_routines sr
      ON sr.user_id = q.user_id AND sr.name = q.routine_name),
d AS (SELECT r.request_id, r.src AS rsrc, d.id AS src, d.day_number FROM r
      JOIN setup_days d ON d.setup_routine_id = r.src {dj.replace('q.', 'r.')}),
s AS (SELECT r.request_id, r.src AS rsrc, s.id AS src, s.name FROM r
      JOIN setup_sessions s ON s.setup_routine_id = r.src {sj.replace('q.', 'r.')}),
j AS (SELECT d.request_id, ds.id AS src, d.src AS dsrc, s.src AS ssrc, ds.session_order
      FROM d JOIN setup_days_sessions ds ON ds.day_id = d.src
      JOIN s ON s.request_id = d.request_id AND s.src = ds.session_id),
x AS (SELECT s.request_id, s.src AS ssrc, x.id AS src, x.exercise_order FROM s
      JOIN setup_session_exercises x ON x.setup_session_id = s.src),
t AS (SELECT x.request_id, x.src AS xsrc, t.id AS src, t.cur_set FROM x
      JOIN setup_exercise_details t ON t.setup_session_exercise_id = x.src)
SELECT 'routine' AS entity, {_h('routine', 'request_id', 'src')} AS id, CAST(NULL AS VARCHAR) AS parent_id,
       CAST(src AS VARCHAR) AS other_id, CAST(NULL AS INTEGER) AS ord FROM r
UNION ALL SELECT 'day', {_h('day', 'request_id', 'src')}, {_h('routine', 'request_id', 'rsrc')},
       CAST(src AS VARCHAR), day_number FROM d
UNION ALL SELECT 'session', {_h('session', 'request_id', 'src')}, {_h('routine', 'request_id', 'rsrc')},
       CAST(src AS VARCHAR), NULL FROM s
UNION ALL SELECT 'slot', {_h('slot', 'request_id', 'src')}, {_h('day', 'request_id', 'dsrc')},
       {_h('session', 'request_id', 'ssrc')}, session_order FROM j
UNION ALL SELECT 'exercise', {_h('exercise', 'request_id', 'src')}, {_h('session', 'request_id', 'ssrc')},
       CAST(src AS VARCHAR), exercise_order FROM x
UNION ALL SELECT 'set', {_h('set', 'request_id', 'src')}, {_h('exercise', 'request_id', 'xsrc')},
       CAST(src AS VARCHAR), cur_set FROM t
"""


@query("i1_snapshot_day", _ACTIVE + "," + _snapshot_sql("""
req AS (SELECT user_id AS request_id, user_id, routine_name, day_number, session_name
        FROM whats_next WHERE session_name IS NOT NULL)""", True))
def i1_snapshot_day(spark, sf):
    """Flow E2: every user starts the workout of their next training day."""
    m = from_driver(spark, sf)
    req = (I.whats_next(m).filter(F.col("session_name").isNotNull())
           .withColumn("request_id", F.col("user_id")))
    return _snapshot_rows(I.snapshot(m, req, RUN))


@query("i2_snapshot_routine", _snapshot_sql("""
req AS (SELECT id AS request_id, user_id, name AS routine_name FROM setup_routines)""", False))
def i2_snapshot_routine(spark, sf):
    m = from_driver(spark, sf)
    req = m.setup_routines.select(F.col("id").alias("request_id"), "user_id",
                                  F.col("name").alias("routine_name"))
    return _snapshot_rows(I.snapshot(m, req, RUN, whole_routine=True))


_LINEAGE_TABLES = ("track_routines", "track_days", "track_sessions", "track_session_exercises", "track_exercise_details")


@query("i3_clear_lineage", "cleared AS (SELECT id FROM track_routines WHERE setup_id IS NOT NULL AND user_id % 2 = 0),\n"
       "gone_lines AS (SELECT line_id FROM lines WHERE l_orderkey IN (SELECT id FROM cleared))\n"
       + "\nUNION ALL ".join(
           f"SELECT '{t}' AS \"table\", CAST(id AS VARCHAR) AS id, CASE WHEN {where} THEN NULL ELSE CAST(setup_id AS VARCHAR) END AS setup_id FROM {t}"
           for t, where in (("track_routines", "id IN (SELECT id FROM cleared)"), ("track_days", "id IN (SELECT id FROM cleared)"),
                            ("track_sessions", "id IN (SELECT id FROM cleared)"),
                            ("track_session_exercises", "id IN (SELECT line_id FROM gone_lines)"),
                            ("track_exercise_details", "track_session_exercise_id IN (SELECT line_id FROM gone_lines)"))), dense=True)
def i3_clear_lineage(spark, sf, model=from_driver):
    """I3 for users with an even id: all five tables of the log, with what is left of their lineage."""
    m = model(spark, sf)
    users = m.users.filter(F.col("id") % 2 == 0).select(F.col("id").alias("user_id"))
    new = I.clear_lineage(m, users)
    parts = [new[t].select(F.lit(t).alias("table"), F.col("id").cast("string"), F.col("setup_id").cast("string")) for t in _LINEAGE_TABLES]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query("i4_append_exercises", f"""
req AS (SELECT o_orderkey * 2 + k AS request_id, k AS seq, o_orderkey AS setup_session_id,
               o_custkey + k AS custom_exercise_id
        FROM orders, (VALUES (0), (1)) v(k) WHERE o_orderkey % 3 = 0),
base AS (SELECT setup_session_id, max(exercise_order) AS mx FROM setup_session_exercises GROUP BY 1)
SELECT {_h('exercise', 'request_id')} AS id, q.setup_session_id, q.custom_exercise_id,
       CAST(coalesce(b.mx, 0) + row_number() OVER (PARTITION BY q.setup_session_id
                                                   ORDER BY q.seq, q.request_id) AS INTEGER)
         AS exercise_order
FROM req q LEFT JOIN base b ON b.setup_session_id = q.setup_session_id""")
def i4_append_exercises(spark, sf):
    m = from_driver(spark, sf)
    new = I.add_session_exercises(m, R.append_exercise_requests(spark, sf), RUN)
    return new["setup_session_exercises"].select("id", "setup_session_id", "custom_exercise_id",
                                                 "exercise_order")


@query("i5_delete_days", """
del AS (SELECT setup_routine_id, day_number FROM setup_days WHERE id % 7 = 0),
kept AS (SELECT d.* FROM setup_days d WHERE NOT EXISTS (
           SELECT 1 FROM del x WHERE x.setup_routine_id = d.setup_routine_id
             AND x.day_number = d.day_number))
SELECT k.id, k.setup_routine_id,
       CAST(k.day_number - (SELECT count(*) FROM del x WHERE x.setup_routine_id = k.setup_routine_id
                            AND x.day_number < k.day_number) AS INTEGER) AS day_number
FROM kept k""")
def i5_delete_days(spark, sf):
    m = from_driver(spark, sf)
    return I.delete_days(m, R.delete_day_requests(m))["setup_days"].select(
        "id", "setup_routine_id", "day_number")


_REORDER_REQ = """
n AS (SELECT setup_session_id, count(*) AS n FROM setup_session_exercises GROUP BY 1),
req AS (
  SELECT x.setup_session_id, x.exercise_order AS old_order,
         CAST(n.n + 1 - x.exercise_order AS VARCHAR) AS new_order
  FROM setup_session_exercises x JOIN n USING (setup_session_id) WHERE x.setup_session_id % 5 = 0
  UNION ALL
  SELECT setup_session_id, exercise_order, '1' FROM setup_session_exercises
  WHERE setup_session_id % 5 = 1),
chk AS (
  SELECT q.setup_session_id, count(*) AS listed,
         count(TRY_CAST(q.new_order AS INTEGER)) AS integers,
         count(DISTINCT TRY_CAST(q.new_order AS INTEGER)) AS distinct_new,
         min(TRY_CAST(q.new_order AS INTEGER)) AS min_new, max(TRY_CAST(q.new_order AS INTEGER)) AS max_new,
         count(x.id) AS existing, count(DISTINCT q.old_order) AS distinct_old,
         coalesce(max(n.n), 0) AS n
  FROM req q LEFT JOIN setup_session_exercises x
    ON x.setup_session_id = q.setup_session_id AND x.exercise_order = q.old_order
  LEFT JOIN n ON n.setup_session_id = q.setup_session_id
  GROUP BY q.setup_session_id),
report AS (
  SELECT setup_session_id, CAST(listed AS BIGINT) AS listed, CAST(n AS BIGINT) AS n,
         CASE WHEN integers < listed THEN 'not an integer'
              WHEN distinct_new < listed THEN 'duplicate order'
              WHEN min_new < 1 OR max_new > n THEN 'order out of range'
              WHEN existing < listed OR distinct_old < listed THEN 'unknown exercise'
              WHEN listed <> n THEN 'incomplete permutation' END AS reason
  FROM chk)
"""


@query("i6_reorder_exercises", _REORDER_REQ + """
SELECT x.id, CAST(coalesce(TRY_CAST(q.new_order AS INTEGER), x.exercise_order) AS INTEGER) AS exercise_order
FROM setup_session_exercises x
LEFT JOIN (SELECT q.* FROM req q JOIN report r ON r.setup_session_id = q.setup_session_id
           WHERE r.reason IS NULL) q
  ON q.setup_session_id = x.setup_session_id AND q.old_order = x.exercise_order""")
def i6_reorder_exercises(spark, sf):
    m = from_driver(spark, sf)
    out, _ = I.reorder(m.setup_session_exercises, "setup_session_id", "exercise_order",
                       R.reorder_requests(m))
    return out.select("id", "exercise_order")


@query("j9_reorder_check", _REORDER_REQ + "SELECT * FROM report")
def j9_reorder_check(spark, sf):
    m = from_driver(spark, sf)
    return I.reorder_check(m.setup_session_exercises, "setup_session_id", "exercise_order",
                           R.reorder_requests(m))


_ASSIGN_REQ = _DAY_SESSION + """,
j AS (SELECT c.c_custkey AS routine_id, d2.session_name AS s2, d3.session_name AS s3
      FROM customer c JOIN day_session d2 ON d2.routine_id = c.c_custkey AND d2.day_number = 2
      JOIN day_session d3 ON d3.routine_id = c.c_custkey AND d3.day_number = 3),
req AS (
  SELECT routine_id * 3 AS request_id, 1 AS seq, routine_id, 1 AS day_number, 1 AS slot,
         s2 AS session_name FROM j
  UNION ALL SELECT routine_id * 3 + 1, 2, routine_id, 1, 2, s3 FROM j
  UNION ALL SELECT c_custkey * 3 + 2, 3, c_custkey, 2, 1, 'No Such Session' FROM customer
  WHERE c_custkey % 5 = 0),
res AS (
  SELECT q.*, d.id AS day_id, s.id AS session_id,
         CASE WHEN q.session_name IS NULL OR trim(q.session_name) = '' THEN 'no session name'
              WHEN s.id IS NULL THEN 'unknown session'
              WHEN d.id IS NULL THEN 'unknown day' END AS reason
  FROM req q LEFT JOIN setup_days d ON d.setup_routine_id = q.routine_id AND d.day_number = q.day_number
  LEFT JOIN setup_sessions s ON s.setup_routine_id = q.routine_id AND s.name = q.session_name)
"""


@query("i7_assign_sessions", _ASSIGN_REQ + f""",
ok AS (SELECT * FROM res r WHERE reason IS NULL AND seq = (
         SELECT max(seq) FROM res r2 WHERE r2.reason IS NULL AND r2.day_id = r.day_id AND r2.slot = r.slot)),
upd AS (SELECT CAST(ds.id AS VARCHAR) AS id, ds.day_id, coalesce(o.session_id, ds.session_id) AS session_id, ds.session_order
        FROM setup_days_sessions ds LEFT JOIN ok o ON o.day_id = ds.day_id AND o.slot = ds.session_order),
ins AS (SELECT o.* FROM ok o WHERE NOT EXISTS (
          SELECT 1 FROM setup_days_sessions ds WHERE ds.day_id = o.day_id AND ds.session_order = o.slot)),
mx AS (SELECT day_id, max(session_order) AS mx FROM setup_days_sessions GROUP BY 1)
SELECT id, day_id, session_id, session_order FROM upd
UNION ALL
SELECT {_h('slot', 'request_id')}, i.day_id, i.session_id,
       CAST(coalesce(m.mx, 0) + row_number() OVER (PARTITION BY i.day_id ORDER BY i.seq, i.request_id)
            AS INTEGER)
FROM ins i LEFT JOIN mx m ON m.day_id = i.day_id""")
def i7_assign_sessions(spark, sf):
    m = from_driver(spark, sf)
    out, _ = I.assign_sessions(m, R.assign_requests(spark, sf, m), RUN)
    return out.select(F.col("id").cast("string").alias("id"), "day_id", "session_id", "session_order")


@query("j10_assign_rejects", _ASSIGN_REQ + "SELECT request_id, reason FROM res WHERE reason IS NOT NULL")
def j10_assign_rejects(spark, sf):
    m = from_driver(spark, sf)
    _, rejected = I.assign_sessions(m, R.assign_requests(spark, sf, m), RUN)
    return rejected


_SET_LOG = _DAY_SESSION + r""",
nd AS (SELECT setup_routine_id AS user_id, count(*) AS n FROM setup_days GROUP BY 1),
ev AS (
  SELECT e.event_id, e.ts, e.user_id, CAST(e.event_id % nd.n + 1 AS INTEGER) AS day_number,
         CAST(CASE WHEN e.event_id % 2 = 0 THEN floor(e.value * 2) / 2 ELSE e.value END AS VARCHAR)
           AS weight_text,
         json_extract_string(e.props, '$.k') AS reps_text
  FROM events e JOIN nd ON nd.user_id = e.user_id),
ev2 AS (
  SELECT ev.*, ds.session_name, 'Plan ' || CAST(ev.user_id AS VARCHAR) AS routine_name,
         trim(weight_text, ' ') AS wt, trim(reps_text, ' ') AS rt
  FROM ev LEFT JOIN day_session ds ON ds.routine_id = ev.user_id AND ds.day_number = ev.day_number),
checked AS (
  SELECT *,
    CASE WHEN wt IS NULL OR wt = '' OR rt IS NULL OR rt = '' THEN 'set:incomplete'
         WHEN NOT regexp_full_match(wt, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') OR TRY_CAST(wt AS DOUBLE) < 0
           THEN 'weight:not_a_number'
         WHEN TRY_CAST(wt AS DOUBLE) * 2 <> floor(TRY_CAST(wt AS DOUBLE) * 2) THEN 'weight:not_a_half_step'
         WHEN TRY_CAST(wt AS DECIMAL(6,2)) IS NULL THEN 'weight:out_of_range'
         WHEN NOT regexp_full_match(rt, '[+-]?[0-9]+') OR TRY_CAST(rt AS INTEGER) IS NULL
              OR TRY_CAST(rt AS INTEGER) < 0 THEN 'reps:not_an_integer_from_0' END AS problem
  FROM ev2)
"""

_TARGETS = """
targets AS (
  SELECT r.user_id, r.name AS routine_name, d.day_number, s.name AS session_name, x.exercise_order,
         t.cur_set AS set_number, t.id AS set_id
  FROM track_routines r JOIN track_days d ON d.track_routine_id = r.id
  JOIN track_days_sessions ds ON ds.day_id = d.id AND ds.session_order = 1
  JOIN track_sessions s ON s.id = ds.session_id
  JOIN track_session_exercises x ON x.track_session_id = s.id
  JOIN track_exercise_details t ON t.track_session_exercise_id = x.id
  WHERE r.in_progress),
ok AS (SELECT event_id, ts, user_id, routine_name, day_number, session_name, 1 AS exercise_order,
              1 AS set_number, CAST(wt AS DECIMAL(6,2)) AS weight, CAST(rt AS INTEGER) AS reps_done
       FROM checked WHERE problem IS NULL),
hit AS (SELECT o.*, t.set_id FROM ok o JOIN targets t USING (user_id, routine_name, day_number,
                                                              session_name, exercise_order, set_number)),
last AS (SELECT set_id, arg_max(weight, (ts, event_id)) AS w, arg_max(reps_done, (ts, event_id)) AS rd
         FROM hit GROUP BY set_id)
SELECT t.id, CAST(CASE WHEN l.set_id IS NOT NULL THEN l.w ELSE t.weight END AS DOUBLE) AS weight,
       CASE WHEN l.set_id IS NOT NULL THEN l.rd ELSE t.reps_done END AS reps_done
FROM track_exercise_details t LEFT JOIN last l ON l.set_id = t.id
"""


@query("i8_update_logged_sets", _SET_LOG + "," + _TARGETS)
def i8_update_logged_sets(spark, sf):
    m = from_driver(spark, sf)
    ok, _ = R.validated_set_log(R.set_log_events(spark, sf, m))
    return I.update_logged_sets(m, ok).select("id", F.col("weight").cast("double"), "reps_done")


@query("j12_set_log_quarantine", _SET_LOG + "SELECT event_id, problem FROM checked WHERE problem IS NOT NULL")
def j12_set_log_quarantine(spark, sf):
    """J6 + J7 + J12 on the set-log events: the quarantined ones with the reason."""
    m = from_driver(spark, sf)
    _, bad = R.validated_set_log(R.set_log_events(spark, sf, m))
    return bad.select("event_id", "problem")


_REP_REQ = """
req AS (
  SELECT x.setup_session_id AS request_group, x.id AS sse_id, 1 AS "set", x.exercise_order AS seq,
         CASE WHEN x.setup_session_id % 8 = 0 AND x.exercise_order = 1 THEN 'abc'
              ELSE CAST(t.reps_goal + 1 AS VARCHAR) END AS reps
  FROM setup_session_exercises x JOIN setup_exercise_details t
    ON t.setup_session_exercise_id = x.id AND t.cur_set = 1
  WHERE x.setup_session_id % 4 = 0),
bad AS (SELECT DISTINCT request_group FROM req
        WHERE NOT regexp_full_match(trim(reps, ' '), '[+-]?[0-9]+') OR TRY_CAST(trim(reps, ' ') AS INTEGER) < 1
           OR TRY_CAST(trim(reps, ' ') AS INTEGER) IS NULL)
"""


@query("i9_set_rep_goals", _REP_REQ + """,
ok AS (SELECT sse_id, "set", arg_max(CAST(trim(reps, ' ') AS INTEGER), seq) AS new_goal
       FROM req WHERE request_group NOT IN (SELECT request_group FROM bad) GROUP BY sse_id, "set")
SELECT t.id, CAST(coalesce(o.new_goal, t.reps_goal) AS INTEGER) AS reps_goal
FROM setup_exercise_details t LEFT JOIN ok o
  ON o.sse_id = t.setup_session_exercise_id AND o."set" = t.cur_set""")
def i9_set_rep_goals(spark, sf):
    m = from_driver(spark, sf)
    out, _ = I.set_rep_goals(m, R.rep_goal_requests(m))
    return out.select("id", "reps_goal")


@query("i10_flip_flags", """
req AS (SELECT c_custkey AS id, 'edit_on' AS action FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'edit_off' FROM customer WHERE c_custkey % 3 = 1
        UNION ALL SELECT c_custkey, 'created' FROM customer WHERE c_custkey % 4 = 0),
f AS (SELECT id, bool_or(action = 'created') AS cr, bool_or(action = 'edit_on') AS eon,
             bool_or(action = 'edit_off') AS eoff FROM req GROUP BY id)
SELECT r.id, CASE WHEN f.cr THEN TRUE ELSE r.routine_created END AS routine_created,
       CASE WHEN f.eoff THEN FALSE WHEN f.eon THEN TRUE ELSE r.routine_edit_in_progress END
         AS routine_edit_in_progress
FROM setup_routines r LEFT JOIN f ON f.id = r.id""")
def i10_flip_flags(spark, sf):
    m = from_driver(spark, sf)
    return I.flip_flags(m, R.flag_requests(spark, sf)).select(
        "id", "routine_created", "routine_edit_in_progress")


_COMPLETE_REQ = """
req AS (SELECT DISTINCT o_custkey AS user_id, 'Plan ' || CAST(o_custkey AS VARCHAR) AS name
        FROM orders WHERE o_orderstatus = 'O'),
hit AS (SELECT t.id FROM track_routines t JOIN req q USING (user_id, name) WHERE t.in_progress)
"""


@query("i11_complete_workouts", _COMPLETE_REQ + f"""
SELECT t.id, CASE WHEN h.id IS NOT NULL THEN FALSE ELSE t.in_progress END AS in_progress,
       CASE WHEN h.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE t.completion_date END AS completion_date
FROM track_routines t LEFT JOIN hit h ON h.id = t.id""")
def i11_complete_workouts(spark, sf):
    m = from_driver(spark, sf)
    out = I.complete_workouts(m, R.complete_requests(spark, sf), AS_OF)["track_routines"]
    return out.select("id", "in_progress", F.col("completion_date").cast("timestamp_ntz"))


@query("i11_cursor_after_completion", _COMPLETE_REQ + """,
moved AS (SELECT DISTINCT t.user_id, r.id AS routine_id FROM track_routines t JOIN hit h ON h.id = t.id
          JOIN setup_routines r ON r.user_id = t.user_id AND r.name = t.name),
ndays AS (SELECT setup_routine_id AS routine_id, count(*) AS total_days FROM setup_days GROUP BY 1)
SELECT u.user_id, u.current_routine_id,
       CAST(CASE WHEN m.user_id IS NOT NULL THEN
              CASE WHEN u.current_day_number < n.total_days THEN u.current_day_number + 1 ELSE 1 END
            ELSE u.current_day_number END AS INTEGER) AS current_day_number,
       u.current_session_number
FROM users_current_details u
LEFT JOIN moved m ON m.user_id = u.user_id AND m.routine_id = u.current_routine_id
LEFT JOIN ndays n ON n.routine_id = u.current_routine_id""")
def i11_cursor_after_completion(spark, sf):
    m = from_driver(spark, sf)
    return I.complete_workouts(m, R.complete_requests(spark, sf), AS_OF)["users_current_details"]


def _entity_ids(new: dict[str, DataFrame]) -> DataFrame:
    out = None
    for t, df in new.items():
        part = df.select(F.lit(t).alias("table"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("i12_discard_open_workouts", """
gone AS (SELECT t.id FROM track_routines t WHERE t.in_progress AND t.user_id % 6 = 0
         AND t.name = 'Plan ' || CAST(t.user_id AS VARCHAR)),
tr AS (SELECT id FROM track_routines WHERE id NOT IN (SELECT id FROM gone)),
td AS (SELECT id FROM track_days WHERE track_routine_id NOT IN (SELECT id FROM gone)),
ts AS (SELECT id FROM track_sessions WHERE track_routine_id NOT IN (SELECT id FROM gone)),
tds AS (SELECT id FROM track_days_sessions WHERE day_id IN (SELECT id FROM td)
        AND session_id IN (SELECT id FROM ts)),
tse AS (SELECT id FROM track_session_exercises WHERE track_session_id IN (SELECT id FROM ts)),
ted AS (SELECT id FROM track_exercise_details WHERE track_session_exercise_id IN (SELECT id FROM tse))
SELECT 'track_routines' AS "table", CAST(id AS VARCHAR) AS id FROM tr
UNION ALL SELECT 'track_days', CAST(id AS VARCHAR) FROM td
UNION ALL SELECT 'track_sessions', CAST(id AS VARCHAR) FROM ts
UNION ALL SELECT 'track_days_sessions', CAST(id AS VARCHAR) FROM tds
UNION ALL SELECT 'track_session_exercises', CAST(id AS VARCHAR) FROM tse
UNION ALL SELECT 'track_exercise_details', CAST(id AS VARCHAR) FROM ted""")
def i12_discard_open_workouts(spark, sf):
    m = from_driver(spark, sf)
    return _entity_ids(I.discard_open_workouts(m, R.discard_requests(spark, sf)))


@query("i13_delete_routines", """
gone AS (SELECT id FROM setup_routines WHERE id % 10 = 0),
sr AS (SELECT id FROM setup_routines WHERE id NOT IN (SELECT id FROM gone)),
sd AS (SELECT id FROM setup_days WHERE setup_routine_id NOT IN (SELECT id FROM gone)),
ss AS (SELECT id FROM setup_sessions WHERE setup_routine_id NOT IN (SELECT id FROM gone)),
sds AS (SELECT id FROM setup_days_sessions WHERE day_id IN (SELECT id FROM sd)
        AND session_id IN (SELECT id FROM ss)),
sse AS (SELECT id FROM setup_session_exercises WHERE setup_session_id IN (SELECT id FROM ss)),
sed AS (SELECT id FROM setup_exercise_details WHERE setup_session_exercise_id IN (SELECT id FROM sse))
SELECT 'setup_routines' AS "table", CAST(id AS VARCHAR) AS id FROM sr
UNION ALL SELECT 'setup_days', CAST(id AS VARCHAR) FROM sd
UNION ALL SELECT 'setup_sessions', CAST(id AS VARCHAR) FROM ss
UNION ALL SELECT 'setup_days_sessions', CAST(id AS VARCHAR) FROM sds
UNION ALL SELECT 'setup_session_exercises', CAST(id AS VARCHAR) FROM sse
UNION ALL SELECT 'setup_exercise_details', CAST(id AS VARCHAR) FROM sed""")
def i13_delete_routines(spark, sf):
    """Cascade delete (no restrict check: the plain I13 operator)."""
    m = from_driver(spark, sf)
    return _entity_ids(I.delete_plan_tree(m, R.delete_routine_requests(spark, sf)))


@query("i14_restrict_check", """
req AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 0),
cur AS (SELECT DISTINCT current_routine_id AS id FROM users_current_details),
lin AS (SELECT DISTINCT setup_id AS id FROM track_routines)
SELECT q.id, CASE WHEN c.id IS NOT NULL AND l.id IS NOT NULL THEN 'current routine, log lineage'
                  WHEN c.id IS NOT NULL THEN 'current routine'
                  WHEN l.id IS NOT NULL THEN 'log lineage' END AS blocked_by
FROM req q LEFT JOIN cur c ON c.id = q.id LEFT JOIN lin l ON l.id = q.id""")
def i14_restrict_check(spark, sf):
    m = from_driver(spark, sf)
    return I.restrict_check(m, R.delete_routine_requests(spark, sf))


_RENAME_REQ = _DAY_SESSION + r""",
req AS (
  SELECT c.c_custkey AS request_id, d1.session_id,
         CASE WHEN floor(c.c_custkey / 4) % 2 = 0 THEN upper(d2.session_name)
              ELSE 'NEW ' || CAST(c.c_custkey AS VARCHAR) END AS new_name
  FROM customer c JOIN day_session d1 ON d1.routine_id = c.c_custkey AND d1.day_number = 1
  LEFT JOIN day_session d2 ON d2.routine_id = c.c_custkey AND d2.day_number = 2
  WHERE c.c_custkey % 4 = 0),
r AS (
  SELECT q.*, s.setup_routine_id, lower(q.new_name) AS lname,
         CASE WHEN q.new_name IS NULL OR length(trim(q.new_name, ' ')) = 0 THEN 'name:empty'
              WHEN length(q.new_name) > 255 THEN 'name:too_long'
              WHEN NOT regexp_full_match(q.new_name, '[a-zA-Z0-9()+\- ]+')
                THEN 'name:bad_character' END AS p
  FROM req q JOIN setup_sessions s ON s.id = q.session_id),
r2 AS (
  SELECT r.*, coalesce(p,
           CASE WHEN EXISTS (SELECT 1 FROM setup_sessions o WHERE o.setup_routine_id = r.setup_routine_id
                             AND lower(o.name) = r.lname AND o.id <> r.session_id) THEN 'name already used'
                WHEN (SELECT count(*) FROM r x WHERE x.setup_routine_id = r.setup_routine_id
                      AND x.lname = r.lname) > 1 THEN 'name requested twice' END) AS reason
  FROM r)
"""


@query("i18_rename_sessions", _RENAME_REQ + """
SELECT s.id, coalesce(r.new_name, s.name) AS name
FROM setup_sessions s LEFT JOIN (SELECT * FROM r2 WHERE reason IS NULL) r ON r.session_id = s.id""")
def i18_rename_sessions(spark, sf):
    m = from_driver(spark, sf)
    out, _ = I.rename_sessions(m, R.rename_requests(spark, sf, m))
    return out.select("id", "name")


@query("i18_rename_rejects", _RENAME_REQ + """
SELECT request_id, session_id, reason FROM r2 WHERE reason IS NOT NULL""")
def i18_rename_rejects(spark, sf):
    m = from_driver(spark, sf)
    _, rejected = I.rename_sessions(m, R.rename_requests(spark, sf, m))
    return rejected


_CREATE_REQ = r"""
req AS (
  SELECT c_custkey * 3 AS request_id, 1 AS seq, c_custkey AS setup_routine_id,
         'Extra ' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey * 3 + 1, 2, c_custkey, 'extra ' || CAST(c_custkey AS VARCHAR)
  FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey * 3 + 2, 3, c_custkey, '  Bad#Name ' FROM customer WHERE c_custkey % 10 = 0),
r AS (
  SELECT request_id, seq, setup_routine_id, trim(name, ' ') AS name, lower(trim(name, ' ')) AS lname,
         CASE WHEN length(trim(name, ' ')) = 0 THEN 'name:empty'
              WHEN length(trim(name, ' ')) > 255 THEN 'name:too_long'
              WHEN NOT regexp_full_match(trim(name, ' '), '[a-zA-Z0-9()+\- ]+')
                THEN 'name:bad_character' END AS p
  FROM req),
firsts AS (SELECT setup_routine_id, lname, arg_min(request_id, (seq, request_id)) AS first_id
           FROM r WHERE p IS NULL GROUP BY 1, 2),
r2 AS (
  SELECT r.*, coalesce(p,
           CASE WHEN EXISTS (SELECT 1 FROM setup_sessions s WHERE s.setup_routine_id = r.setup_routine_id
                             AND lower(s.name) = r.lname) THEN 'name already used'
                WHEN f.first_id <> r.request_id THEN 'duplicate in batch' END) AS reason
  FROM r LEFT JOIN firsts f ON f.setup_routine_id = r.setup_routine_id AND f.lname = r.lname)
"""


@query("i19_create_sessions", _CREATE_REQ + f"""
SELECT {_h('session', 'request_id')} AS id, setup_routine_id, name FROM r2 WHERE reason IS NULL""")
def i19_create_sessions(spark, sf):
    m = from_driver(spark, sf)
    new, _ = I.create_named(m.setup_sessions, "setup_routine_id", R.create_session_requests(spark, sf),
                            RUN, "session")
    return new


@query("i19_create_rejects", _CREATE_REQ + """
SELECT request_id, setup_routine_id, name, reason FROM r2 WHERE reason IS NOT NULL""")
def i19_create_rejects(spark, sf):
    m = from_driver(spark, sf)
    _, rejected = I.create_named(m.setup_sessions, "setup_routine_id",
                                 R.create_session_requests(spark, sf), RUN, "session")
    return rejected


@query("i20_resolve_drafts", f"""
d AS (SELECT user_id, count(*) AS n, min(id) AS draft_id FROM setup_routines
      WHERE NOT routine_created GROUP BY 1)
SELECT u.id AS user_id, coalesce(CAST(d.draft_id AS VARCHAR), {_h('draft', 'u.id')}) AS routine_id,
       d.draft_id IS NULL AS created
FROM users u LEFT JOIN d ON d.user_id = u.id WHERE d.n IS NULL OR d.n = 1""")
def i20_resolve_drafts(spark, sf):
    m = from_driver(spark, sf)
    out, _ = I.resolve_drafts(m, m.users.select(F.col("id").alias("user_id")), RUN)
    return out
