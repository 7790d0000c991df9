"""Registered queries: sources and sinks (A), remaining transform variants,
and the start-workout / history flows (E2, E3)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from regimen.functions import scalar as H
from regimen.operators import lookup as B
from regimen.operators import nesting as D
from regimen.operators import outline as C
from regimen.operators import paging as P
from regimen.operators import quality as J
from regimen.operators import transform as I
from regimen.operators import upkeep as K
from regimen.plans import requests as R
from regimen.plans.q_outline import _D5_SQL
from regimen.plans.q_rules import _ALL_RULES, _COMPLETED, _fk_sql
from regimen.plans.q_transform import _ACTIVE, _h
from regimen.plans.registry import query
from regimen.session import checkpoint_dir
from regimen.sources.adapter import driver_table, from_driver
from regimen.sources.tables import TableStore, derived_view, split_parent_child

RUN = R.RUN

# --- A: sources and sinks -------------------------------------------------------------

ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@query("a1_read_with_schema", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'""")
def a1_read_with_schema(spark, sf):
    """A1: a declared schema (no inference); the filter and the 3 columns reach the scan."""
    o = spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf}/orders.parquet")
    return o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderdate")


@query("a1_read_model_table", "SELECT id, username, password FROM users")
def a1_read_model_table(spark, sf):
    """A1 on the stored model: the users table as the store wrote it."""
    return from_driver(spark, sf).users.select("id", "username", "password")


_A3_PREFIX = _D5_SQL[:_D5_SQL.rindex("SELECT routine_id")].rstrip()
_A3_FINAL = _D5_SQL[_D5_SQL.rindex("SELECT routine_id"):]


@query("a3_derived_view", _A3_PREFIX + ", d5 AS (" + _A3_FINAL + """)
SELECT routine_id, day_number, count(exercise_name) AS exercises, count(DISTINCT session_pos) AS sessions
FROM d5 GROUP BY routine_id, day_number""")
def a3_derived_view(spark, sf):
    """A3: a derived table (the day outline) as a temp view queried with SQL."""
    view = f"day_outline_{uuid.uuid4().hex[:8]}"
    derived_view(D.day_outline(from_driver(spark, sf)), view)
    return spark.sql(f"""
        SELECT routine_id, day_number, count(exercise_name) AS exercises,
               count(DISTINCT session_pos) AS sessions
        FROM {view} GROUP BY routine_id, day_number""")


_I5_SQL = """
del AS (SELECT setup_routine_id, day_number FROM setup_days WHERE id % 7 = 0),
kept AS (SELECT d.* FROM setup_days d WHERE NOT EXISTS (
           SELECT 1 FROM del x WHERE x.setup_routine_id = d.setup_routine_id
             AND x.day_number = d.day_number))
SELECT k.id, k.setup_routine_id,
       CAST(k.day_number - (SELECT count(*) FROM del x WHERE x.setup_routine_id = k.setup_routine_id
                            AND x.day_number < k.day_number) AS INTEGER) AS day_number
FROM kept k"""


@query("a4_versioned_write", _I5_SQL)
def a4_versioned_write(spark, sf):
    """A4: a change becomes new table versions in a store; read back the latest."""
    m = from_driver(spark, sf)
    new = I.delete_days(m, R.delete_day_requests(m))
    store = TableStore(spark, f"{checkpoint_dir(spark)}/regimen-a4/{uuid.uuid4().hex}")
    store.commit(new)                    # days and their slots become visible together
    return store.load().setup_days.select("id", "setup_routine_id", "day_number")


@query("a5_parent_and_child", """
SELECT 'users' AS "table", CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer
UNION ALL SELECT 'users_current_details', CAST(c_custkey AS VARCHAR), NULL FROM customer""")
def a5_parent_and_child(spark, sf):
    """A5: sign-up rows and their cursor rows from one keyed request frame."""
    c = R.customers(spark, sf)
    users, cursors = split_parent_child(c, {"id": "c_custkey", "username": "c_name"},
                                        {"user_id": "c_custkey"})
    return (users.select(F.lit("users").alias("table"), F.col("id").cast("string").alias("key"),
                         F.col("username").alias("value"))
            .unionByName(cursors.select(F.lit("users_current_details").alias("table"),
                                        F.col("user_id").cast("string").alias("key"),
                                        F.lit(None).cast("string").alias("value"))))


# --- I: remaining variants ---------------------------------------------------------------

@query("i4_add_days", f"""
req AS (SELECT c_custkey * 2 + k AS request_id, k AS seq, c_custkey AS setup_routine_id
        FROM customer, (VALUES (0), (1)) v(k)
        WHERE c_custkey % 4 = 0 AND (k = 0 OR c_custkey % 8 = 0)),
base AS (SELECT setup_routine_id, count(*) AS n FROM setup_days GROUP BY 1)
SELECT {_h('day', 'request_id')} AS id,
       CAST(coalesce(b.n, 0) + row_number() OVER (PARTITION BY q.setup_routine_id
                                                  ORDER BY q.seq, q.request_id) AS INTEGER) AS day_number,
       q.setup_routine_id
FROM req q LEFT JOIN base b ON b.setup_routine_id = q.setup_routine_id""")
def i4_add_days(spark, sf):
    """I4 (COUNT form): customers % 4 = 0 add a day, customers % 8 = 0 two."""
    m = from_driver(spark, sf)
    c = R.customers(spark, sf).select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    req = (c.filter((F.col("c_custkey") % 4 == 0) & ((F.col("k") == 0) | (F.col("c_custkey") % 8 == 0)))
           .select((F.col("c_custkey") * 2 + F.col("k")).alias("request_id"), F.col("k").alias("seq"),
                   F.col("c_custkey").alias("setup_routine_id")))
    return I.add_days(m, req, RUN)


@query("i4_add_logged_sets", f"""
req AS (SELECT x.id AS request_id, 1 AS seq, x.id AS track_session_exercise_id
        FROM track_session_exercises x JOIN track_sessions s ON s.id = x.track_session_id
        JOIN track_routines r ON r.id = s.track_routine_id
        WHERE r.in_progress AND x.exercise_order = 1),
base AS (SELECT track_session_exercise_id, count(cur_set) AS n FROM track_exercise_details GROUP BY 1)
SELECT {_h('set', 'request_id')} AS id, q.track_session_exercise_id,
       CAST(coalesce(b.n, 0) + row_number() OVER (PARTITION BY q.track_session_exercise_id
                                                  ORDER BY q.seq, q.request_id) AS INTEGER) AS cur_set
FROM req q LEFT JOIN base b ON b.track_session_exercise_id = q.track_session_exercise_id""")
def i4_add_logged_sets(spark, sf):
    """I4 (log, COUNT(cur_set) form): one more set on the first exercise of every open workout."""
    m = from_driver(spark, sf)
    open_ex = (m.track_session_exercises.filter(F.col("exercise_order") == 1)
               .join(m.track_sessions.select(F.col("id").alias("track_session_id"),
                                             F.col("track_routine_id")), "track_session_id")
               .join(m.track_routines.filter("in_progress").select(F.col("id").alias("track_routine_id")),
                     "track_routine_id"))
    req = open_ex.select(F.col("id").alias("request_id"), F.lit(1).alias("seq"),
                         F.col("id").alias("track_session_exercise_id"))
    return I.add_logged_sets(m, req, RUN).select("id", "track_session_exercise_id", "cur_set")


@query("i5_delete_session_exercises", """
del AS (SELECT setup_session_id, exercise_order FROM setup_session_exercises
        WHERE setup_session_id % 3 = 0 AND exercise_order IN (2, 4)),
kept AS (SELECT x.* FROM setup_session_exercises x WHERE NOT EXISTS (
           SELECT 1 FROM del d WHERE d.setup_session_id = x.setup_session_id
             AND d.exercise_order = x.exercise_order))
SELECT k.id, k.setup_session_id,
       CAST(k.exercise_order - (SELECT count(*) FROM del d WHERE d.setup_session_id = k.setup_session_id
                                AND d.exercise_order < k.exercise_order) AS INTEGER) AS exercise_order
FROM kept k""")
def i5_delete_session_exercises(spark, sf):
    """I5 (exercises): sessions % 3 = 0 drop their 2nd and 4th exercise."""
    m = from_driver(spark, sf)
    d = (m.setup_session_exercises.filter((F.col("setup_session_id") % 3 == 0)
                                          & F.col("exercise_order").isin(2, 4))
         .select(F.col("setup_session_id").alias("session_id"), "exercise_order"))
    return I.delete_session_exercises(m, d)["setup_session_exercises"].select(
        "id", "setup_session_id", "exercise_order")


@query("i6_reorder_logged", """
n AS (SELECT track_session_id, count(*) AS n FROM track_session_exercises GROUP BY 1),
req AS (SELECT x.track_session_id, x.exercise_order AS old_order, n.n + 1 - x.exercise_order AS new_order
        FROM track_session_exercises x JOIN n USING (track_session_id) WHERE x.track_session_id % 5 = 2)
SELECT x.id, CAST(coalesce(q.new_order, x.exercise_order) AS INTEGER) AS exercise_order
FROM track_session_exercises x LEFT JOIN req q
  ON q.track_session_id = x.track_session_id AND q.old_order = x.exercise_order""")
def i6_reorder_logged(spark, sf):
    """I6 (log): reverse the exercises of logged sessions % 5 = 2 (all valid)."""
    m = from_driver(spark, sf)
    x = m.track_session_exercises.select("track_session_id", "exercise_order")
    n = x.groupBy("track_session_id").agg(F.count(F.lit(1)).alias("n"))
    req = (x.filter(F.col("track_session_id") % 5 == 2).join(n, "track_session_id")
           .select("track_session_id", F.col("exercise_order").alias("old_order"),
                   (F.col("n") + 1 - F.col("exercise_order")).alias("new_order")))
    out, _ = I.reorder(m.track_session_exercises, "track_session_id", "exercise_order", req)
    return out.select("id", "exercise_order")


@query("i13_delete_sessions", """
gone AS (SELECT id FROM setup_sessions WHERE id % 9 = 0),
ss AS (SELECT id FROM setup_sessions WHERE id NOT IN (SELECT id FROM gone)),
sds AS (SELECT id FROM setup_days_sessions WHERE session_id IN (SELECT id FROM ss)),
sse AS (SELECT id FROM setup_session_exercises WHERE setup_session_id IN (SELECT id FROM ss)),
sed AS (SELECT id FROM setup_exercise_details WHERE setup_session_exercise_id IN (SELECT id FROM sse))
SELECT 'setup_routines' AS "table", CAST(id AS VARCHAR) AS id FROM setup_routines
UNION ALL SELECT 'setup_days', CAST(id AS VARCHAR) FROM setup_days
UNION ALL SELECT 'setup_sessions', CAST(id AS VARCHAR) FROM ss
UNION ALL SELECT 'setup_days_sessions', CAST(id AS VARCHAR) FROM sds
UNION ALL SELECT 'setup_session_exercises', CAST(id AS VARCHAR) FROM sse
UNION ALL SELECT 'setup_exercise_details', CAST(id AS VARCHAR) FROM sed""")
def i13_delete_sessions(spark, sf):
    """I13 (sessions): delete the sessions of orders % 9 = 0 by (routine, name)."""
    m = from_driver(spark, sf)
    req = (m.setup_sessions.filter(F.col("id") % 9 == 0)
           .select(F.col("setup_routine_id").alias("routine_id"), F.col("name").alias("session_name")))
    new = I.delete_sessions(m, req)
    out = None
    for t, df in new.items():
        part = df.select(F.lit(t).alias("table"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("j3_dangling_after_plain_delete", """
kept_routines AS (SELECT * FROM setup_routines WHERE id % 10 <> 0)
""" + _fk_sql({"setup_routines": "kept_routines"}))
def j3_dangling_after_plain_delete(spark, sf):
    """J3 after deleting routines without the cascade: what the cascade prevents."""
    m = from_driver(spark, sf)
    m2 = m.replace(setup_routines=m.setup_routines.filter(F.col("id") % 10 != 0))
    return J.all_dangling_references(m2)


# --- E2 / E3: flows ----------------------------------------------------------------------

@query("e2_start_workout", _ACTIVE + f""",
req AS (SELECT user_id AS request_id, user_id, routine_name, day_number, session_name
        FROM whats_next WHERE session_name IS NOT NULL),
new_active AS (
  SELECT q.user_id, q.day_number, q.session_name, {_h('session', 'q.request_id', 's.id')} AS session_id
  FROM req q JOIN setup_routines r ON r.user_id = q.user_id AND r.name = q.routine_name
  JOIN setup_days d ON d.setup_routine_id = r.id AND d.day_number = q.day_number
  JOIN setup_days_sessions ds ON ds.day_id = d.id
  JOIN setup_sessions s ON s.id = ds.session_id AND s.setup_routine_id = r.id AND s.name = q.session_name),
old_active AS (
  SELECT r.user_id, d.day_number, s.name AS session_name, CAST(s.id AS VARCHAR) AS session_id
  FROM track_routines r JOIN track_days d ON r.id = d.track_routine_id
  JOIN track_days_sessions ds ON d.id = ds.day_id JOIN track_sessions s ON ds.session_id = s.id
  WHERE r.in_progress)
SELECT a.* FROM (SELECT * FROM new_active UNION ALL SELECT * FROM old_active) a
JOIN req q ON q.user_id = a.user_id AND q.day_number = a.day_number AND q.session_name = a.session_name""")
def e2_start_workout(spark, sf):
    """Flow E2: every user starts their next workout (I16 -> I1 -> I3), then the
    open session of (user, day, session name) is looked up (C10)."""
    m = from_driver(spark, sf)
    checkpoint_dir(spark)
    req = (I.whats_next(m).filter(F.col("session_name").isNotNull())
           .withColumn("request_id", F.col("user_id"))).checkpoint()             # asked three times below
    m2 = I.append_snapshot(m, I.snapshot(m, req, RUN))
    m3 = m2.replace(**I.clear_lineage(m2, req.select("user_id")))
    active = C.active_sessions(m3)
    return (active.join(req.select("user_id", "day_number", "session_name"),
                        ["user_id", "day_number", "session_name"])
            .select("user_id", "day_number", "session_name", F.col("session_id").cast("string")))


@query("e3_history_pages", _COMPLETED + """
SELECT user_id, CAST(floor((row_number() OVER w - 1) / 3) + 1 AS INTEGER) AS page,
       CAST(row_number() OVER w AS INTEGER) AS record_pos,
       strftime((completion_date AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%m/%d/%Y')
         AS shown_date,
       routine_name, day_number, session_name
FROM completed
WINDOW w AS (PARTITION BY user_id ORDER BY completion_date DESC NULLS FIRST, routine_id, day_number,
             session_name)""")
def e3_history_pages(spark, sf):
    """Flow E3: every user's history pages with local dates (C12 + F4 + H8)."""
    r = P.record_pages(from_driver(spark, sf))
    return r.select("user_id", "page", "record_pos", H.local_date("completion_date").alias("shown_date"),
                    "routine_name", "day_number", "session_name")


_CREATE_EX = r"""
owned AS (SELECT user_id, min(name) AS first_name FROM custom_exercises WHERE user_id IS NOT NULL
          GROUP BY user_id),
req AS (
  SELECT c_custkey * 3 AS request_id, 1 AS seq, c_custkey AS user_id,
         'Exercise ' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey * 3 + 1, 2, c_custkey, 'EXERCISE ' || CAST(c_custkey AS VARCHAR)
  FROM customer WHERE c_custkey % 14 = 0
  UNION ALL SELECT user_id * 3 + 2, 3, user_id, upper(first_name) FROM owned WHERE user_id % 7 = 0),
r AS (
  SELECT request_id, seq, user_id, trim(name, ' ') AS name, lower(trim(name, ' ')) AS lname,
         CASE WHEN length(trim(name, ' ')) = 0 THEN 'name:empty'
              WHEN length(trim(name, ' ')) > 255 THEN 'name:too_long'
              WHEN NOT regexp_full_match(trim(name, ' '), '[a-zA-Z0-9()+\- ]+')
                THEN 'name:bad_character' END AS p
  FROM req),
firsts AS (SELECT user_id, lname, arg_min(request_id, (seq, request_id)) AS first_id
           FROM r WHERE p IS NULL GROUP BY 1, 2),
r2 AS (
  SELECT r.*, coalesce(p,
           CASE WHEN EXISTS (SELECT 1 FROM custom_exercises c WHERE c.user_id = r.user_id
                             AND lower(c.name) = r.lname) THEN 'name already used'
                WHEN f.first_id <> r.request_id THEN 'duplicate in batch' END) AS reason
  FROM r LEFT JOIN firsts f ON f.user_id = r.user_id AND f.lname = r.lname)
"""


def _create_exercise_requests(spark, sf, m):
    c = R.customers(spark, sf).select(F.col("c_custkey").alias("user_id"))
    k = F.col("user_id")
    a = c.filter(k % 7 == 0).select((k * 3).alias("request_id"), F.lit(1).alias("seq"), "user_id",
                                    F.concat(F.lit("Exercise "), k.cast("string")).alias("name"))
    b = c.filter(k % 14 == 0).select((k * 3 + 1).alias("request_id"), F.lit(2).alias("seq"), "user_id",
                                     F.concat(F.lit("EXERCISE "), k.cast("string")).alias("name"))
    owned = (m.custom_exercises.filter(F.col("user_id").isNotNull())
             .groupBy("user_id").agg(F.min("name").alias("first_name")))
    d = owned.filter(k % 7 == 0).select((k * 3 + 2).alias("request_id"), F.lit(3).alias("seq"), "user_id",
                                        F.upper("first_name").alias("name"))
    return a.unionByName(b).unionByName(d)


@query("i19_create_custom_exercises", _CREATE_EX + f"""
SELECT {_h('custom_exercise', 'request_id')} AS id, user_id, name FROM r2 WHERE reason IS NULL""")
def i19_create_custom_exercises(spark, sf):
    """I19 (exercises): users % 7 = 0 add one; % 14 = 0 repeat it in upper case; some
    re-add an exercise they own in upper case (refused, names are unique per user, any case)."""
    m = from_driver(spark, sf)
    new, _ = I.create_named(m.custom_exercises, "user_id", _create_exercise_requests(spark, sf, m),
                            RUN, "custom_exercise")
    return new


@query("i19_custom_exercise_rejects", _CREATE_EX + """
SELECT request_id, user_id, name, reason FROM r2 WHERE reason IS NOT NULL""")
def i19_custom_exercise_rejects(spark, sf):
    m = from_driver(spark, sf)
    _, rejected = I.create_named(m.custom_exercises, "user_id", _create_exercise_requests(spark, sf, m),
                                 RUN, "custom_exercise")
    return rejected


@query("f1_sorted_outline", """
SELECT routine_id AS user_id, routine_id, day_number, session_order, exercise_order, cur_set
FROM plan_days JOIN part_sets USING (session_id) WHERE exercise_name IS NOT NULL ORDER BY 1, 2, 3, 4, 5, 6""")
def f1_sorted_outline(spark, sf):
    """the plan outline in the reference's order (owner first, NULLs last)."""
    out = C.sort_outline(C.plan_outline(from_driver(spark, sf)))
    return out.select("user_id", "routine_id", "day_number", "session_order", "exercise_order", "cur_set")


@query("h4_parse_instants", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'not a date'
                               ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed
FROM events""")
def h4_parse_instants(spark, sf):
    """H4: instants shown as text parse back (at second precision); bad text gives NULL."""
    ev = driver_table(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("not a date")).otherwise(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", H.to_instant(text).cast("timestamp_ntz").alias("parsed"))


# --- variants of I4, I18, I19, I20 and D6 on C13 --------------------------------------------

@query("i4_add_planned_sets", f"""
req AS (SELECT line_id AS request_id, line_id FROM lines WHERE l_orderkey % 4 = 1)
SELECT {_h('set', 'request_id')} AS id, line_id AS setup_session_exercise_id, CAST(s.last + 1 AS INTEGER) AS cur_set
FROM req JOIN (SELECT setup_session_exercise_id AS line_id, max(cur_set) AS last FROM setup_exercise_details GROUP BY 1) s USING (line_id)""",
       dense=True)
def i4_add_planned_sets(spark, sf, model=from_driver):
    """I4 (plan): one more set, at MAX + 1, for the exercises of every fourth session."""
    m = model(spark, sf)
    req = (m.setup_session_exercises.filter(F.col("setup_session_id") % 4 == 1)
           .select(F.col("id").alias("request_id"), F.lit(1).alias("seq"), F.col("id").alias("setup_session_exercise_id")))
    return I.add_planned_sets(m, req, RUN).select("id", "setup_session_exercise_id", "cur_set")


@query("i4_add_logged_exercises", f"""
req AS (SELECT o_orderkey AS request_id, o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'),
n AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
placed AS (SELECT req.*, CAST(coalesce(n, 0) + 1 AS INTEGER) AS place FROM req LEFT JOIN n USING (o_orderkey))
SELECT {_h('exercise', 'request_id')} AS exercise_id, o_orderkey AS track_session_id, o_custkey AS custom_exercise_id,
       place AS exercise_order, {_h('set', 'request_id')} AS set_id, 1 AS cur_set FROM placed""")
def i4_add_logged_exercises(spark, sf):
    """I4 (log): an exercise at COUNT + 1 with its first set, in every open workout."""
    m = from_driver(spark, sf)
    req = (m.track_sessions.join(m.track_routines.filter("in_progress").select(F.col("id").alias("track_routine_id"), "user_id"), "track_routine_id")
           .select(F.col("id").alias("request_id"), F.lit(1).alias("seq"), F.col("id").alias("track_session_id"), F.col("user_id").alias("custom_exercise_id")))
    new = I.add_logged_exercises(m, req, RUN)
    sets = new["track_exercise_details"].select(F.col("track_session_exercise_id").alias("exercise_id"), F.col("id").alias("set_id"), "cur_set")
    return (new["track_session_exercises"].select(F.col("id").alias("exercise_id"), "track_session_id", "custom_exercise_id", "exercise_order")
            .join(sets, "exercise_id"))


_RENAME_ROUTINES = r"""
req AS (
  SELECT c_custkey AS request_id, c_custkey AS routine_id,
         CASE c_custkey % 6 WHEN 0 THEN '  Strength ' || CAST(c_custkey AS VARCHAR) || ' '
                            WHEN 1 THEN 'plan ' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN '   '
                            WHEN 3 THEN repeat('x', 101) WHEN 4 THEN 'a#b' ELSE repeat('y', 100) END AS new_name
  FROM customer),
judged AS (
  SELECT *, trim(new_name, ' ') AS clean,
         CASE WHEN trim(new_name, ' ') = '' THEN 'name:empty' WHEN length(trim(new_name, ' ')) > 100 THEN 'name:too_long'
              WHEN NOT regexp_full_match(trim(new_name, ' '), '[a-zA-Z0-9()+\- ]+')
                THEN 'name:bad_character' END AS reason
  FROM req)
"""


@query("i18_rename_routines", _RENAME_ROUTINES + """
SELECT c_custkey AS id, CASE WHEN reason IS NULL THEN clean ELSE 'Plan ' || CAST(c_custkey AS VARCHAR) END AS name
FROM customer JOIN judged ON routine_id = c_custkey""")
def i18_rename_routines(spark, sf):
    """I18 for routines: trimmed names, a case-only change of the own name, names of 100 and 101 characters."""
    m = from_driver(spark, sf)
    return I.rename_routines(m, R.rename_routine_requests(spark, sf))[0].select("id", "name")


@query("i18_rename_routine_rejects", _RENAME_ROUTINES + "SELECT request_id, routine_id, reason FROM judged WHERE reason IS NOT NULL")
def i18_rename_routine_rejects(spark, sf):
    m = from_driver(spark, sf)
    return I.rename_routines(m, R.rename_routine_requests(spark, sf))[1]


@query("i19_create_sessions_on_days", f"""
firsts AS (SELECT o_custkey, o_orderkey AS day_id FROM day_numbers WHERE day_number = 1)
SELECT {_h('session', 'c_custkey')} AS session_id, c_custkey AS setup_routine_id, 'New ' || CAST(c_custkey AS VARCHAR) AS name,
       day_id, 9 AS session_order
FROM customer JOIN firsts ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0""")
def i19_create_sessions_on_days(spark, sf):
    """A new session placed on day 1; every third request names a day that doesn't exist."""
    m = from_driver(spark, sf)
    c = R.customers(spark, sf).select(F.col("c_custkey").alias("request_id"), F.lit(1).alias("seq"), F.col("c_custkey").alias("setup_routine_id"))
    day = F.when(F.col("setup_routine_id") % 3 == 0, 0).otherwise(1)
    req = c.withColumn("day_number", day).withColumn("slot", F.lit(9)).withColumn("name", F.concat(F.lit("New "), F.col("setup_routine_id").cast("string")))
    new, _ = I.create_sessions_on_days(m, req, RUN)
    slots = new["setup_days_sessions"].select("session_id", "day_id", "session_order")
    return new["setup_sessions"].select(F.col("id").alias("session_id"), "setup_routine_id", "name").join(slots, "session_id")


@query("i20_new_drafts", f"""
drafts AS (SELECT user_id, count(*) AS n FROM setup_routines WHERE NOT routine_created GROUP BY 1)
SELECT {_h('draft', 'c_custkey')} AS id, CAST(NULL AS VARCHAR) AS name, c_custkey AS user_id,
       FALSE AS routine_created, FALSE AS routine_edit_in_progress
FROM customer LEFT JOIN drafts ON user_id = c_custkey WHERE n IS NULL""", dense=True)
def i20_new_drafts(spark, sf, model=from_driver):
    """The draft rows made for users without one."""
    m = model(spark, sf)
    found, _ = I.resolve_drafts(m, m.users.select(F.col("id").alias("user_id")), RUN)
    return I.new_drafts(found)


@query("d6_workout_page", """
plain AS (SELECT workout_id AS request_id, exercise_order, exercise_name, comment AS exercise_comment, cur_set, set_id, reps_goal, weight, reps_done
          FROM log_days JOIN part_sets USING (session_id) WHERE NOT is_open AND exercise_name IS NOT NULL),
flagged AS (
  SELECT *, row_number() OVER w AS pos,
         CASE WHEN lag(exercise_order) OVER w IS DISTINCT FROM exercise_order OR lag(exercise_name) OVER w IS DISTINCT FROM exercise_name
              THEN 1 ELSE 0 END AS fresh
  FROM plain WINDOW w AS (PARTITION BY request_id ORDER BY exercise_order, cur_set, set_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY request_id ORDER BY pos) AS run FROM flagged)
SELECT request_id, CAST(run AS INTEGER) AS exercise_pos, exercise_name, exercise_order, exercise_comment,
       CAST(row_number() OVER (PARTITION BY request_id, run ORDER BY pos) AS INTEGER) AS set_pos, cur_set, reps_goal, weight, reps_done
FROM numbered""")
def d6_workout_page(spark, sf):
    """C13 + D6: every completed workout's exercises with comment and sets."""
    m = from_driver(spark, sf)
    req = C.completed_workouts(m).withColumnRenamed("routine_id", "request_id")
    page = D.workout_page(m, req)
    return page.select("request_id", "exercise_pos", "exercise_name", "exercise_order", "exercise_comment", "set_pos", "cur_set", "reps_goal",
                       F.col("weight").cast("double"), "reps_done")


@query("i7_repeated_requests", """
twice AS (SELECT a.o_orderkey AS day_id, b.o_orderkey AS winner FROM day_numbers a JOIN day_numbers b USING (o_custkey)
          WHERE a.day_number = 1 AND b.day_number = 3)
SELECT o_orderkey AS day_id, CAST(coalesce(winner, o_orderkey) AS BIGINT) AS session_id, 1 AS session_order
FROM orders LEFT JOIN twice ON day_id = o_orderkey""")
def i7_repeated_requests(spark, sf):
    """Two requests of equal ``seq`` for one slot; the larger request id wins, once."""
    m = from_driver(spark, sf)
    ds = R.day_session(m)
    wanted = ds.filter("day_number IN (2, 3)").select("routine_id", F.col("day_number").alias("k"), "session_name")
    three = ds.filter("day_number = 3").select("routine_id")
    req = wanted.join(three, "routine_id", "left_semi").select(
        (F.col("routine_id") * 4 + F.col("k")).alias("request_id"), F.lit(1).alias("seq"), "routine_id", F.lit(1).alias("day_number"),
        F.lit(1).alias("slot"), "session_name")
    return I.assign_sessions(m, req, RUN)[0].select("day_id", "session_id", "session_order")


# --- addresses: logged exercises, sessions by name, restricted deletes ---------------------------

_NEXT_PLACE = "SELECT track_session_id, exercise_order + 1 AS exercise_order FROM track_session_exercises"


@query("b7_logged_exercise_ids", f"""
SELECT q.track_session_id, q.exercise_order, x.id AS track_session_exercise_id
FROM ({_NEXT_PLACE}) q LEFT JOIN track_session_exercises x USING (track_session_id, exercise_order)""")
def b7_logged_exercise_ids(spark, sf):
    """B7 on the log: the exercise after each logged one; the last of a session names nothing."""
    m = from_driver(spark, sf)
    req = m.track_session_exercises.selectExpr("track_session_id", "exercise_order + 1 AS exercise_order")
    return B.logged_exercise_ids(m, req)


@query("i4_add_logged_sets_by_order", f"""
req AS (SELECT id AS request_id, track_session_id, exercise_order + 1 AS exercise_order FROM track_session_exercises),
found AS (SELECT q.request_id, x.id AS parent FROM req q LEFT JOIN track_session_exercises x USING (track_session_id, exercise_order)),
base AS (SELECT track_session_exercise_id AS parent, count(cur_set) AS n FROM track_exercise_details GROUP BY 1)
SELECT {_h('set', 'request_id')} AS id, parent, CAST(coalesce(n, 0) + 1 AS INTEGER) AS cur_set, NULL AS reason FROM found LEFT JOIN base USING (parent)
WHERE parent IS NOT NULL
UNION ALL SELECT request_id, NULL, NULL, 'unknown exercise' FROM found WHERE parent IS NULL""")
def i4_add_logged_sets_by_order(spark, sf):
    """I4 (log) by address: every logged exercise asks for a set of the next one in its session."""
    m = from_driver(spark, sf)
    req = m.track_session_exercises.selectExpr("id AS request_id", "1 AS seq", "track_session_id", "exercise_order + 1 AS exercise_order")
    new, bad = I.add_logged_sets_by_order(m, req, RUN)
    return (new.selectExpr("id", "track_session_exercise_id AS parent", "cur_set", "CAST(NULL AS STRING) AS reason")
            .unionByName(bad.selectExpr("request_id AS id", "CAST(NULL AS STRING) AS parent", "CAST(NULL AS INT) AS cur_set", "reason")))


_RENAME_NAMED = """
req AS (SELECT id AS request_id, setup_routine_id AS routine_id, CASE WHEN id % 3 = 0 THEN lower(name) ELSE name END AS session_name,
               CASE WHEN id % 5 = 0 THEN '  ' ELSE ' Day ' || CAST(id AS VARCHAR) END AS new_name FROM setup_sessions WHERE id % 2 = 1),
found AS (SELECT q.*, s.id FROM req q LEFT JOIN setup_sessions s ON s.setup_routine_id = q.routine_id AND s.name = q.session_name),
judged AS (SELECT *, CASE WHEN id IS NULL THEN 'unknown session' WHEN trim(new_name, ' ') = '' THEN 'name:empty' END AS reason FROM found)
"""


@query("i18_rename_sessions_by_name", _RENAME_NAMED + """
SELECT CAST(s.id AS VARCHAR) AS id, coalesce(trim(j.new_name, ' '), s.name) AS name, NULL AS reason
FROM setup_sessions s LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) j ON j.id = s.id
UNION ALL SELECT CAST(request_id AS VARCHAR), NULL, reason FROM judged WHERE reason IS NOT NULL""")
def i18_rename_sessions_by_name(spark, sf):
    """I18 by the present name (B2): odd sessions; those of keys % 3 = 0 are asked for in other case, % 5 = 0 get a blank."""
    m = from_driver(spark, sf)
    req = m.setup_sessions.filter("id % 2 = 1").selectExpr(
        "id AS request_id", "1 AS seq", "setup_routine_id AS routine_id", "IF(id % 3 = 0, lower(name), name) AS session_name",
        "IF(id % 5 = 0, '  ', concat(' Day ', CAST(id AS STRING))) AS new_name")
    new, bad = I.rename_sessions_named(m, req)
    return (new.selectExpr("CAST(id AS STRING) AS id", "name", "CAST(NULL AS STRING) AS reason")
            .unionByName(bad.selectExpr("CAST(request_id AS STRING) AS id", "CAST(NULL AS STRING) AS name", "reason")))


@query("i14_delete_allowed_routines", """
req AS (SELECT id FROM setup_routines WHERE id % 2 = 0),
held AS (SELECT id, id IN (SELECT current_routine_id FROM users_current_details WHERE current_routine_id IS NOT NULL) AS cur,
                id IN (SELECT setup_id FROM track_routines WHERE setup_id IS NOT NULL) AS lin FROM req),
gone AS (SELECT id FROM held WHERE NOT cur AND NOT lin),
ss AS (SELECT id FROM setup_sessions WHERE setup_routine_id NOT IN (SELECT id FROM gone)),
sse AS (SELECT id FROM setup_session_exercises WHERE setup_session_id IN (SELECT id FROM ss))
SELECT 'setup_routines' AS "table", CAST(id AS VARCHAR) AS id, NULL AS blocked_by FROM setup_routines WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'setup_days', CAST(id AS VARCHAR), NULL FROM setup_days WHERE setup_routine_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'setup_sessions', CAST(id AS VARCHAR), NULL FROM ss
UNION ALL SELECT 'setup_days_sessions', CAST(id AS VARCHAR), NULL FROM setup_days_sessions WHERE session_id IN (SELECT id FROM ss)
UNION ALL SELECT 'setup_session_exercises', CAST(id AS VARCHAR), NULL FROM sse
UNION ALL SELECT 'setup_exercise_details', CAST(id AS VARCHAR), NULL FROM setup_exercise_details WHERE setup_session_exercise_id IN (SELECT id FROM sse)
UNION ALL SELECT 'blocked', CAST(id AS VARCHAR), concat_ws(', ', CASE WHEN cur THEN 'current routine' END, CASE WHEN lin THEN 'log lineage' END)
FROM held WHERE cur OR lin""")
def i14_delete_allowed_routines(spark, sf):
    """I13 + I14: every second routine is to be deleted; those that are current or have lineage stay, the others go with all below."""
    m = from_driver(spark, sf)
    new, blocked = I.delete_routines(m, m.setup_routines.filter("id % 2 = 0").select("id"))
    out = blocked.selectExpr("'blocked' AS `table`", "CAST(id AS STRING) AS id", "blocked_by")
    for t, df in new.items():
        out = out.unionByName(df.selectExpr(f"'{t}' AS `table`", "CAST(id AS STRING) AS id", "CAST(NULL AS STRING) AS blocked_by"))
    return out


# --- J1-J5 on changes only -------------------------------------------------------------------

_V2 = {"setup_days": "SELECT * FROM setup_days WHERE id % 7 <> 0",
       "setup_sessions": """SELECT id, setup_routine_id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'Again' ELSE name END AS name FROM setup_sessions
                            UNION ALL SELECT * FROM setup_sessions WHERE id % 17 = 0""",
       "track_exercise_details": """SELECT * REPLACE (CASE WHEN cur_set = 2 THEN 0 ELSE cur_set END AS cur_set,
                                    track_session_exercise_id || CASE WHEN reps_goal = 7 THEN '?' ELSE '' END AS track_session_exercise_id)
                                    FROM track_exercise_details"""}


def _after(sql: str) -> str:
    """The rules' text over the changed tables."""
    for t in _V2:
        sql = re.sub(rf"FROM {t}\b", f"FROM v2_{t}", sql)
    return ",\n".join(f"v2_{t} AS ({text})" for t, text in _V2.items()) + "\n" + sql


@query("j_report_from_changes", _after(_ALL_RULES), dense=True)
def j_report_from_changes(spark, sf, model=from_driver):
    """J1-J5 of a second version, from the report of the first and the changes of three tables (deleted days, renamed,
    unnamed and doubled sessions, moved and renumbered sets) between two store versions."""
    m = model(spark, sf)
    store = TableStore(spark, f"{checkpoint_dir(spark)}/regimen-report/{uuid.uuid4().hex}")
    store.commit(m.tables)
    first = store.load(1)
    report = J.model_violations(first, apart=True)               # before the second version is on the disk too
    sets, sessions = first.track_exercise_details, first.setup_sessions
    name = F.expr("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'Again' ELSE name END")
    store.commit({"setup_days": first.setup_days.filter("id % 7 <> 0"),
                  "setup_sessions": sessions.withColumn("name", name).unionByName(sessions.filter("id % 17 = 0")),
                  "track_exercise_details": sets.withColumn("cur_set", F.expr("IF(cur_set = 2, 0, cur_set)")).withColumn(
                      "track_session_exercise_id", F.expr("concat(track_session_exercise_id, IF(reps_goal = 7, '?', ''))"))})
    delta = K.report_delta(first, store.load(2), K.changed_tables(store, 1, 2), apart=True)
    return K.apply_delta(report, delta)
