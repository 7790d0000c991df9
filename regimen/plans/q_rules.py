"""Registered queries: lookups (B), rules (J), paging (F), set operations (G)
and scalar functions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimen.functions import scalar as H
from regimen.operators import lookup as B
from regimen.operators import paging as P
from regimen.operators import quality as J
from regimen.operators import setops as G
from regimen.operators.outline import completed_workouts, session_plan
from regimen.plans import requests as R
from regimen.plans.q_outline import COMPLETED_SQL as _COMPLETED
from regimen.plans.registry import query
from regimen.sources import schema as S
from regimen.sources.adapter import driver_table, from_driver

# --- B: lookups -----------------------------------------------------------------------


@query("b1_routine_ids", """
SELECT c_custkey AS user_id, q.routine_name, r.id AS routine_id
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN lower('Plan ' || CAST(c_custkey AS VARCHAR))
                             ELSE 'Plan ' || CAST(c_custkey AS VARCHAR) END AS routine_name
      FROM customer) q
LEFT JOIN setup_routines r ON r.user_id = q.c_custkey AND r.name = q.routine_name""")
def b1_routine_ids(spark, sf):
    m = from_driver(spark, sf)
    req = R.select_routine_requests(spark, sf).drop("seq")
    return B.routine_ids(m, req)


@query("b1_routine_names", """
SELECT c_custkey AS user_id, q.routine_id, r.name AS routine_name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 1 ELSE c_custkey END AS routine_id
      FROM customer) q
LEFT JOIN setup_routines r ON r.user_id = q.c_custkey AND r.id = q.routine_id""")
def b1_routine_names(spark, sf):
    m = from_driver(spark, sf)
    c = R.customers(spark, sf)
    req = c.select(F.col("c_custkey").alias("user_id"),
                   F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey") + 1)
                   .otherwise(F.col("c_custkey")).alias("routine_id"))
    return B.routine_names(m, req)


@query("b2_session_ids", """
SELECT q.routine_id, q.session_name, s.id AS session_id
FROM (SELECT o_custkey AS routine_id,
             CASE WHEN o_orderkey % 9 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END
               || ' ' || CAST(o_orderkey AS VARCHAR) AS session_name FROM orders) q
LEFT JOIN setup_sessions s ON s.setup_routine_id = q.routine_id AND s.name = q.session_name""")
def b2_session_ids(spark, sf):
    m = from_driver(spark, sf)
    o = driver_table(spark, sf, "orders")
    prio = F.when(F.col("o_orderkey") % 9 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    req = o.select(F.col("o_custkey").alias("routine_id"),
                   F.concat(prio, F.lit(" "), F.col("o_orderkey").cast("string")).alias("session_name"))
    return B.session_ids(m, req)


@query("b3_day_ids", """
SELECT q.routine_id, q.day_number, d.id AS day_id
FROM (SELECT o_custkey AS routine_id, CAST(o_orderkey % 30 + 1 AS INTEGER) AS day_number FROM orders) q
LEFT JOIN setup_days d ON d.setup_routine_id = q.routine_id AND d.day_number = q.day_number""")
def b3_day_ids(spark, sf):
    m = from_driver(spark, sf)
    o = driver_table(spark, sf, "orders")
    req = o.select(F.col("o_custkey").alias("routine_id"),
                   (F.col("o_orderkey") % 30 + 1).cast("int").alias("day_number"))
    return B.day_ids(m, req)


@query("b4_slot_ids", """
SELECT q.day_id, q.session_order, ds.id AS slot_id
FROM (SELECT o_orderkey AS day_id, CAST(1 + o_orderkey % 2 AS INTEGER) AS session_order FROM orders) q
LEFT JOIN setup_days_sessions ds ON ds.day_id = q.day_id AND ds.session_order = q.session_order""")
def b4_slot_ids(spark, sf):
    m = from_driver(spark, sf)
    o = driver_table(spark, sf, "orders")
    req = o.select(F.col("o_orderkey").alias("day_id"),
                   (F.col("o_orderkey") % 2 + 1).cast("int").alias("session_order"))
    return B.slot_ids(m, req)


@query("b5_custom_exercise_ids", """
q AS (SELECT user_id, CASE WHEN id % 2 = 0 THEN name ELSE upper(name) END AS exercise_name
      FROM custom_exercises WHERE user_id IS NOT NULL)
SELECT q.user_id, q.exercise_name, min(c.id) AS exercise_id
FROM q LEFT JOIN custom_exercises c ON c.user_id = q.user_id AND c.name = q.exercise_name
GROUP BY q.user_id, q.exercise_name""")
def b5_custom_exercise_ids(spark, sf):
    m = from_driver(spark, sf)
    ce = m.custom_exercises.filter(F.col("user_id").isNotNull())
    req = ce.select("user_id", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.upper("name"))
                    .alias("exercise_name"))
    # one answer per distinct question
    return B.custom_exercise_ids(m, req.distinct())


@query("b6_user_ids", """
SELECT q.username, u.id AS user_id
FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE c_name END AS username
      FROM customer) q LEFT JOIN users u ON u.username = q.username""")
def b6_user_ids(spark, sf):
    m = from_driver(spark, sf)
    c = R.customers(spark, sf)
    req = c.select(F.when(F.col("c_custkey") % 5 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
                   .alias("username"))
    return B.user_ids(m, req)


@query("b7_session_exercise_ids", """
SELECT q.session_id, q.exercise_order, x.id AS sse_id
FROM (SELECT setup_session_id AS session_id, exercise_order + 1 AS exercise_order
      FROM setup_session_exercises) q
LEFT JOIN (SELECT x.* FROM setup_session_exercises x
           WHERE x.custom_exercise_id IN (SELECT id FROM custom_exercises)) x
  ON x.setup_session_id = q.session_id AND x.exercise_order = q.exercise_order""")
def b7_session_exercise_ids(spark, sf):
    m = from_driver(spark, sf)
    req = m.setup_session_exercises.select(F.col("setup_session_id").alias("session_id"),
                                           (F.col("exercise_order") + 1).alias("exercise_order"))
    return B.session_exercise_ids(m, req)


@query("b8_open_without_date", "SELECT id FROM track_routines WHERE completion_date IS NULL")
def b8_open_without_date(spark, sf):
    return B.with_nulls(from_driver(spark, sf).track_routines, "completion_date").select("id")


@query("b9_created_routines", "SELECT id FROM setup_routines WHERE routine_created")
def b9_created_routines(spark, sf):
    return B.flagged(from_driver(spark, sf).setup_routines, "routine_created").select("id")


@query("b10_session_name_exists", """
q AS (SELECT o_custkey AS routine_id,
             CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR))
                  ELSE 'Missing ' || CAST(o_orderkey AS VARCHAR) END AS session_name FROM orders)
SELECT q.routine_id, q.session_name, EXISTS (
  SELECT 1 FROM setup_sessions s WHERE s.setup_routine_id = q.routine_id
    AND lower(s.name) = lower(q.session_name)) AS "exists"
FROM q""")
def b10_session_name_exists(spark, sf):
    m = from_driver(spark, sf)
    o = driver_table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0,
                  F.lower(F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"))))\
        .otherwise(F.concat(F.lit("Missing "), F.col("o_orderkey").cast("string")))
    req = o.select(F.col("o_custkey").alias("routine_id"), name.alias("session_name"))
    return B.session_name_exists(m, req)


@query("b11_routine_name_like", """
q AS (SELECT c_custkey AS request_id, c_custkey AS user_id,
             CASE c_custkey % 3 WHEN 0 THEN 'plan ' || CAST(c_custkey AS VARCHAR)
                                WHEN 1 THEN 'PLAN %' ELSE 'Plan _' END AS pattern FROM customer)
SELECT q.request_id, q.user_id, q.pattern, EXISTS (
  SELECT 1 FROM setup_routines r WHERE r.user_id = q.user_id AND r.routine_created
    AND r.name ILIKE q.pattern) AS "exists"
FROM q""")
def b11_routine_name_like(spark, sf):
    m = from_driver(spark, sf)
    c = R.customers(spark, sf)
    k = F.col("c_custkey")
    pat = (F.when(k % 3 == 0, F.concat(F.lit("plan "), k.cast("string")))
           .when(k % 3 == 1, F.lit("PLAN %")).otherwise(F.lit("Plan _")))
    req = c.select(k.alias("request_id"), k.alias("user_id"), pat.alias("pattern"))
    return B.routine_name_like(m, req)


@query("b12_routine_name_exact", """
q AS (SELECT c_custkey AS user_id,
             CASE WHEN c_custkey % 7 = 0 THEN lower('Plan ' || CAST(c_custkey AS VARCHAR))
                  ELSE 'Plan ' || CAST(c_custkey AS VARCHAR) END AS routine_name FROM customer)
SELECT q.user_id, q.routine_name, EXISTS (SELECT 1 FROM setup_routines r WHERE r.user_id = q.user_id
                                          AND r.name = q.routine_name) AS "exists"
FROM q""")
def b12_routine_name_exact(spark, sf):
    m = from_driver(spark, sf)
    return B.routine_name_exact(m, R.select_routine_requests(spark, sf).drop("seq"))


@query("b13_open_sessions", """
SELECT id FROM track_sessions WHERE track_routine_id IN (SELECT id FROM track_routines WHERE in_progress)""")
def b13_open_sessions(spark, sf):
    m = from_driver(spark, sf)
    return B.in_subquery(m.track_sessions, "track_routine_id",
                         m.track_routines.filter("in_progress"), "id").select("id")


@query("b14_next_exercise_order", """
SELECT s.id AS track_session_id,
       CAST((SELECT count(*) FROM track_session_exercises x WHERE x.track_session_id = s.id) + 1 AS INTEGER)
         AS next_order
FROM track_sessions s""")
def b14_next_exercise_order(spark, sf):
    m = from_driver(spark, sf)
    keys = m.track_sessions.select(F.col("id").alias("track_session_id"))
    v = B.per_key_value(m.track_session_exercises, "track_session_id", F.count(F.lit(1)), "_n", keys)
    return v.select("track_session_id", (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("next_order"))


@query("b15_later_exercises", "SELECT id, exercise_order FROM setup_session_exercises WHERE exercise_order > 2")
def b15_later_exercises(spark, sf):
    m = from_driver(spark, sf)
    return B.above(m.setup_session_exercises, "exercise_order", 2).select("id", "exercise_order")


@query("b16_second_match", """
q AS (SELECT id AS request_id, user_id, name, completion_date + INTERVAL 400 MILLISECOND AS shown
      FROM track_routines WHERE completion_date IS NOT NULL)
SELECT q.request_id, t.id
FROM q JOIN track_routines t ON t.user_id = q.user_id AND t.name = q.name
 AND date_trunc('second', t.completion_date) = date_trunc('second', q.shown)""")
def b16_second_match(spark, sf):
    """A date shown with millisecond precision finds its workout again."""
    m = from_driver(spark, sf)
    tr = m.track_routines
    req = (tr.filter(F.col("completion_date").isNotNull())
           .select(F.col("id").alias("request_id"), "user_id", "name",
                   (F.col("completion_date") + F.expr("INTERVAL 400 MILLISECONDS")).alias("shown")))
    return B.match_second(req, "shown", tr.select("id", "user_id", "name", "completion_date"),
                          "completion_date", ["user_id", "name"]).select("request_id", "id")


# --- J: rules as violation reports ------------------------------------------------------

def _key_sql(cols) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _unique_sql() -> str:
    parts = []
    for t, cols in [(t, c) for t, c in S.PRIMARY_KEYS.items()]:
        parts.append(f"SELECT 'primary_key' AS rule, '{t}' AS \"table\", {_key_sql(cols)} AS key, "
                     f"CAST(count(*) AS VARCHAR) AS detail FROM {t} WHERE "
                     + " AND ".join(f"{c} IS NOT NULL" for c in cols)
                     + f" GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    for t, cols in S.UNIQUE:
        parts.append(f"SELECT 'unique', '{t}', {_key_sql(cols)}, CAST(count(*) AS VARCHAR) FROM {t} WHERE "
                     + " AND ".join(f"{c} IS NOT NULL" for c in cols)
                     + f" GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    return "\nUNION ALL ".join(parts)


@query("j1_unique_keys", _unique_sql(), dense=True)
def j1_unique_keys(spark, sf, model=from_driver):
    return J.unique_keys(model(spark, sf))


@query("j1_duplicate_line_keys", """
SELECT 'unique' AS rule, 'lineitem' AS "table", concat_ws('|', CAST(l_orderkey AS VARCHAR),
       CAST(l_linenumber AS VARCHAR)) AS key, CAST(count(*) AS VARCHAR) AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def j1_duplicate_line_keys(spark, sf):
    """J1 on a raw table: (l_orderkey, l_linenumber) is not a key."""
    return J.duplicate_keys(driver_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


def _lower_sql() -> str:
    parts = []
    for t, owner, name in S.UNIQUE_LOWER:
        keys = ([owner] if owner else []) + [f"lower({name})"]
        parts.append(f"SELECT 'unique_lower' AS rule, '{t}' AS \"table\", {_key_sql(keys)} AS key, "
                     f"CAST(count(*) AS VARCHAR) AS detail FROM {t} WHERE {name} IS NOT NULL "
                     f"GROUP BY {', '.join(keys)} HAVING count(*) > 1")
    return "\nUNION ALL ".join(parts)


@query("j2_unique_lower_names", _lower_sql(), dense=True)
def j2_unique_lower_names(spark, sf, model=from_driver):
    return J.lower_names(model(spark, sf))


def _fk_sql(source: dict[str, str] | None = None) -> str:
    """Union of one anti-join per foreign key; ``source`` maps a table to the
    relation that stands for it (a changed version)."""
    src = source or {}
    parts = []
    for t, col, pt, pcol, _ in S.FOREIGN_KEYS:
        parts.append(f"SELECT 'foreign_key' AS rule, '{t}' AS \"table\", CAST(c.{col} AS VARCHAR) AS key, "
                     f"'{col}' AS detail FROM {src.get(t, t)} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {src.get(pt, pt)} p WHERE CAST(p.{pcol} AS VARCHAR) = "
                     f"CAST(c.{col} AS VARCHAR))")
    return "\nUNION ALL ".join(parts)


@query("j3_foreign_keys", _fk_sql(), dense=True)
def j3_foreign_keys(spark, sf, model=from_driver):
    return J.all_dangling_references(model(spark, sf))


def _check_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT 'check' AS rule, '{t}' AS \"table\", CAST({c} AS VARCHAR) AS key, "
        f"'{c} {op} {b}' AS detail FROM {t} WHERE NOT ({c} {op} {b})" for t, c, op, b in S.CHECKS)


@query("j4_checks", _check_sql(), dense=True)
def j4_checks(spark, sf, model=from_driver):
    return J.row_violations(model(spark, sf), "check")


def _not_null_sql() -> str:
    from regimen.sources.schema import SCHEMAS
    parts = []
    for t, c in S.NOT_NULL:
        key = "CAST(id AS VARCHAR)" if "id" in SCHEMAS[t].fieldNames() else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT 'not_null' AS rule, '{t}' AS \"table\", {key} AS key, '{c}' AS detail "
                     f"FROM {t} WHERE {c} IS NULL")
    return "\nUNION ALL ".join(parts)


@query("j5_not_null", _not_null_sql(), dense=True)
def j5_not_null(spark, sf, model=from_driver):
    return J.row_violations(model(spark, sf), "not_null")


_ALL_RULES = "\nUNION ALL ".join((_unique_sql(), _lower_sql(), _fk_sql(), _check_sql(), _not_null_sql()))


@query("j_model_violations", _ALL_RULES, dense=True)
def j_model_violations(spark, sf, model=from_driver):
    """J1-J5 over the whole model in one report."""
    return J.model_violations(model(spark, sf))


_NAME_SQL = r"""
SELECT 'name' AS rule, '{t}' AS "table", CAST({key} AS VARCHAR) AS key,
       CASE WHEN {n} IS NULL OR length(trim({n}, ' ')) = 0 THEN 'name:empty'
            WHEN length(trim({n}, ' ')) > {mx} THEN 'name:too_long'
            ELSE 'name:bad_character' END AS detail
FROM {t} WHERE {n} IS NULL OR length(trim({n}, ' ')) = 0 OR length(trim({n}, ' ')) > {mx}
   OR NOT regexp_full_match(trim({n}, ' '), '[a-zA-Z0-9()+\- ]+')"""

_NAMED = [("users", "username", "id", S.NAME_MAX), ("custom_exercises", "name", "id", S.NAME_MAX),
          ("setup_sessions", "name", "id", S.NAME_MAX), ("setup_routines", "name", "id", S.ROUTINE_NAME_MAX)]


@query("j8_names", "\nUNION ALL ".join(_NAME_SQL.format(t=t, n=n, key=k, mx=mx) for t, n, k, mx in _NAMED))
def j8_names(spark, sf):
    m = from_driver(spark, sf)
    return G.union_all(*[J.name_violations(m[t], n, k, t, mx) for t, n, k, mx in _NAMED])


@query("j11_multiple_drafts", """
SELECT 'one_draft' AS rule, 'setup_routines' AS "table", CAST(user_id AS VARCHAR) AS key,
       CAST(count(*) AS VARCHAR) AS detail
FROM setup_routines WHERE NOT routine_created GROUP BY user_id HAVING count(*) > 1""", dense=True)
def j11_multiple_drafts(spark, sf, model=from_driver):
    return J.multiple_drafts(model(spark, sf))


@query("j11_multiple_open_workouts", """
SELECT 'one_open_workout' AS rule, 'track_routines' AS "table", CAST(user_id AS VARCHAR) AS key,
       CAST(count(*) AS VARCHAR) AS detail
FROM track_routines WHERE in_progress GROUP BY user_id HAVING count(*) > 1""")
def j11_multiple_open_workouts(spark, sf):
    """Users with more than one open workout (reported, as SURVEY §2.1 decides)."""
    return J.multiple_open_workouts(from_driver(spark, sf))


@query("j13_exercise_choice", """
q AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                       CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS request_id,
             o_custkey AS user_id, p_name AS exercise_name
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT q.request_id, q.user_id, q.exercise_name,
       CASE WHEN q.exercise_name IS NULL OR trim(q.exercise_name, ' ') = '' THEN 'no exercise chosen'
            WHEN NOT EXISTS (SELECT 1 FROM custom_exercises c WHERE c.user_id = q.user_id
                             AND c.name = q.exercise_name) THEN 'unknown exercise' END AS reason
FROM q""")
def j13_exercise_choice(spark, sf):
    """Every line item as a choice of its customer: is the part one of theirs?"""
    m = from_driver(spark, sf)
    from regimen.sources.adapter import line_id
    li = driver_table(spark, sf, "lineitem")
    o = driver_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = driver_table(spark, sf, "part").select("p_partkey", "p_name")
    req = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
           .join(p, F.col("l_partkey") == F.col("p_partkey"))
           .select(line_id().alias("request_id"), F.col("o_custkey").alias("user_id"),
                   F.col("p_name").alias("exercise_name")))
    return J.exercise_choice_problem(m, req)


@query("j14_empty_routines", """
SELECT 'day_and_session' AS rule, 'setup_routines' AS "table", CAST(r.id AS VARCHAR) AS key,
       CASE WHEN d.id IS NULL AND s.id IS NULL THEN 'no day and no session'
            WHEN d.id IS NULL THEN 'no day' ELSE 'no session' END AS detail
FROM setup_routines r
LEFT JOIN (SELECT DISTINCT setup_routine_id AS id FROM setup_days) d ON d.id = r.id
LEFT JOIN (SELECT DISTINCT setup_routine_id AS id FROM setup_sessions) s ON s.id = r.id
WHERE d.id IS NULL OR s.id IS NULL""", dense=True)
def j14_empty_routines(spark, sf, model=from_driver):
    return J.empty_routines(model(spark, sf))


# --- F: paging --------------------------------------------------------------------------

@query("f2_slot_row_pages", """
placed AS (
  SELECT routine_id, day_number, session_name,
         CAST(row_number() OVER (PARTITION BY routine_id ORDER BY day_number, session_order NULLS LAST, slot_id NULLS LAST) AS INTEGER) AS row_pos
  FROM plan_days)
SELECT *, CAST(floor((row_pos - 1) / 3) + 1 AS INTEGER) AS page FROM placed""", dense=True)
def f2_slot_row_pages(spark, sf, model=from_driver):
    return P.slot_row_pages(model(spark, sf)).select("routine_id", "day_number", "session_name",
                                                           "row_pos", "page")


@query("f3_day_pages", """
SELECT setup_routine_id AS routine_id, day_number,
       CAST(row_number() OVER w AS INTEGER) AS day_pos,
       CAST(floor((row_number() OVER w - 1) / 3) + 1 AS INTEGER) AS page
FROM setup_days WINDOW w AS (PARTITION BY setup_routine_id ORDER BY day_number, id)""")
def f3_day_pages(spark, sf):
    return P.day_pages(from_driver(spark, sf)).select("routine_id", "day_number", "day_pos", "page")


@query("f4_record_pages", _COMPLETED + """
SELECT user_id, routine_id, completion_date, day_number, session_name,
       CAST(row_number() OVER w AS INTEGER) AS record_pos,
       CAST(floor((row_number() OVER w - 1) / 3) + 1 AS INTEGER) AS page
FROM completed
WINDOW w AS (PARTITION BY user_id ORDER BY completion_date DESC NULLS FIRST, routine_id, day_number,
             session_name)""")
def f4_record_pages(spark, sf):
    """Flow E3: every user's history, newest first, 3 per page."""
    r = P.record_pages(from_driver(spark, sf))
    return r.select("user_id", "routine_id", F.col("completion_date").cast("timestamp_ntz"), "day_number",
                    "session_name", "record_pos", "page")


@query("f5_day_page_counts", """
SELECT r.id AS routine_id, CAST(count(d.id) AS BIGINT) AS total_days,
       CAST(greatest(ceil(count(d.id) / 3), 1) AS INTEGER) AS total_pages
FROM setup_routines r LEFT JOIN setup_days d ON d.setup_routine_id = r.id GROUP BY r.id""")
def f5_day_page_counts(spark, sf):
    return P.day_page_counts(from_driver(spark, sf))


@query("f5_record_page_counts", _COMPLETED + """
SELECT u.id AS user_id, CAST(coalesce(n.records, 0) AS BIGINT) AS records,
       CAST(greatest(ceil(coalesce(n.records, 0) / 3), 1) AS INTEGER) AS total_pages
FROM users u LEFT JOIN (SELECT user_id, count(*) AS records FROM completed GROUP BY 1) n
  ON n.user_id = u.id""")
def f5_record_page_counts(spark, sf):
    return P.record_page_counts(from_driver(spark, sf))


@query("f5_page_after_removal", """
del AS (SELECT id FROM setup_days WHERE id % 7 = 0),
before AS (SELECT setup_routine_id AS routine_id, count(*) AS n FROM setup_days GROUP BY 1),
after AS (SELECT setup_routine_id AS routine_id, count(*) AS n FROM setup_days
          WHERE id NOT IN (SELECT id FROM del) GROUP BY 1)
SELECT b.routine_id, CAST(least(ceil(coalesce(a.n, 0) / 3), greatest(ceil(b.n / 3), 1)) AS INTEGER) AS page
FROM before b LEFT JOIN after a ON a.routine_id = b.routine_id""")
def f5_page_after_removal(spark, sf):
    """After the I5 deletes, the page to show when the last page was open."""
    from regimen.operators.transform import delete_days
    m = from_driver(spark, sf)
    before = m.setup_days.groupBy(F.col("setup_routine_id").alias("routine_id")).agg(
        F.count(F.lit(1)).alias("n_before"))
    after_days = delete_days(m, R.delete_day_requests(m))["setup_days"]
    after = after_days.groupBy(F.col("setup_routine_id").alias("routine_id")).agg(
        F.count(F.lit(1)).alias("n_after"))
    j = before.join(after, "routine_id", "left")
    return j.select("routine_id", P.page_after_removal(
        F.coalesce("n_after", F.lit(0)), P.total_pages(F.col("n_before"), S.DAYS_PER_PAGE),
        S.DAYS_PER_PAGE).alias("page"))


@query("f6_valid_page_requests", _COMPLETED + r"""
, n AS (SELECT user_id, count(*) AS records FROM completed GROUP BY 1),
t AS (SELECT u.id AS user_id, greatest(ceil(coalesce(n.records, 0) / 3), 1) AS total_pages
      FROM users u LEFT JOIN n ON n.user_id = u.id),
q AS (SELECT c_custkey AS request_id, c_custkey AS user_id,
             CASE WHEN c_custkey % 11 = 0 THEN 'x' WHEN c_custkey % 7 = 0 THEN '1.0'
                  ELSE ' ' || CAST(c_custkey % 5 AS VARCHAR) END AS page FROM customer)
SELECT q.request_id, q.user_id, q.page, CAST(t.total_pages AS INTEGER) AS total_pages,
       coalesce(regexp_full_match(trim(q.page, ' '), '[+-]?[0-9]+')
                AND TRY_CAST(trim(q.page, ' ') AS INTEGER) BETWEEN 1 AND t.total_pages, FALSE) AS valid
FROM q LEFT JOIN t ON t.user_id = q.user_id""")
def f6_valid_page_requests(spark, sf):
    m = from_driver(spark, sf)
    k = F.col("c_custkey")
    page = (F.when(k % 11 == 0, F.lit("x")).when(k % 7 == 0, F.lit("1.0"))
            .otherwise(F.concat(F.lit(" "), (k % 5).cast("string"))))
    req = R.customers(spark, sf).select(k.alias("request_id"), k.alias("user_id"), page.alias("page"))
    return P.valid_page_requests(req, P.record_page_counts(m), "user_id")


@query("f7_sorted_sessions", """
SELECT setup_routine_id, name, CAST(row_number() OVER (PARTITION BY setup_routine_id ORDER BY name, id)
       AS INTEGER) AS pos FROM setup_sessions""")
def f7_sorted_sessions(spark, sf):
    m = from_driver(spark, sf)
    return P.sorted_names(m.setup_sessions.select("id", "setup_routine_id", "name"),
                          "setup_routine_id", "name").drop("id")


@query("f7_sorted_custom_exercises", """
SELECT user_id, name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY name, id) AS INTEGER) AS pos
FROM custom_exercises WHERE user_id IS NOT NULL""")
def f7_sorted_custom_exercises(spark, sf):
    m = from_driver(spark, sf)
    ce = m.custom_exercises.filter(F.col("user_id").isNotNull())
    return P.sorted_names(ce, "user_id", "name").drop("id")


# --- G: set operations ------------------------------------------------------------------

@query("g1_workout_headers", """
SELECT 'open' AS state, user_id, id AS routine_id FROM track_routines WHERE in_progress
UNION ALL SELECT 'done', user_id, id FROM track_routines WHERE NOT in_progress""")
def g1_workout_headers(spark, sf):
    tr = from_driver(spark, sf).track_routines
    return G.union_all(tr.filter("in_progress").select(F.lit("open").alias("state"), "user_id",
                                                       F.col("id").alias("routine_id")),
                       tr.filter("NOT in_progress").select(F.lit("done").alias("state"), "user_id",
                                                           F.col("id").alias("routine_id")))


@query("g2_repeated_exercise_names", """
SELECT x.setup_session_id AS session_id, ce.name, CAST(count(*) AS BIGINT) AS n
FROM setup_session_exercises x JOIN custom_exercises ce ON x.custom_exercise_id = ce.id
JOIN setup_exercise_details t ON x.id = t.setup_session_exercise_id
GROUP BY 1, 2 HAVING count(*) > 1""")
def g2_repeated_exercise_names(spark, sf):
    return G.duplicates(session_plan(from_driver(spark, sf)), ["session_id", "name"])


# --- H: scalar functions ------------------------------------------------------------------

@query("h8_local_dates", _COMPLETED + """
SELECT routine_id, strftime((completion_date AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles',
                            '%m/%d/%Y') AS shown_date
FROM completed""")
def h8_local_dates(spark, sf):
    c = completed_workouts(from_driver(spark, sf))
    return c.select("routine_id", H.local_date(F.col("completion_date")).alias("shown_date"))


@query("h10_field_names", r"""
SELECT t.id,
       CAST(regexp_extract('day' || CAST(d.day_number AS VARCHAR) || '_session1_field', 'day(\d+)_', 1) AS INTEGER)
         AS day_from_field,
       CAST(regexp_extract('day' || CAST(d.day_number AS VARCHAR) || '_session1_field', 'session(\d+)', 1)
            AS INTEGER) AS session_from_field,
       starts_with('day' || CAST(d.day_number AS VARCHAR) || '_session1_field', 'day') AS is_day_field,
       CAST(split_part('order-' || CAST(x.exercise_order AS VARCHAR), '-', 2) AS INTEGER) AS order_from_field,
       CAST(split_part('reps_for_set_' || CAST(t.cur_set AS VARCHAR), '_', 4) AS INTEGER) AS set_from_field
FROM setup_exercise_details t JOIN setup_session_exercises x ON x.id = t.setup_session_exercise_id
JOIN setup_days d ON d.id = x.setup_session_id""")
def h10_field_names(spark, sf):
    """Form field names of every planned set parsed back to numbers."""
    m = from_driver(spark, sf)
    x = (m.setup_exercise_details.select("id", F.col("setup_session_exercise_id").alias("sse"), "cur_set")
         .join(m.setup_session_exercises.select(F.col("id").alias("sse"), "setup_session_id", "exercise_order"),
               "sse")
         .join(m.setup_days.select(F.col("id").alias("setup_session_id"), "day_number"), "setup_session_id"))
    day_field = F.concat(F.lit("day"), F.col("day_number").cast("string"), F.lit("_session1_field"))
    return x.select(
        "id", H.field_day_number(day_field).alias("day_from_field"),
        H.field_session_number(day_field).alias("session_from_field"),
        H.is_day_field(day_field).alias("is_day_field"),
        H.split_part(F.concat(F.lit("order-"), F.col("exercise_order").cast("string")), "-", 1)
        .cast("int").alias("order_from_field"),
        H.split_part(F.concat(F.lit("reps_for_set_"), F.col("cur_set").cast("string")), "_", 3)
        .cast("int").alias("set_from_field"))


@query("h_text_functions", r"""
SELECT c_custkey, trim(' ' || c_name || ' ', ' ') AS trimmed, lower(c_name) AS lowered,
       regexp_full_match(c_name, '[a-zA-Z0-9()+\- ]+') AS name_ok,
       CASE WHEN regexp_full_match(trim(t, ' '), '[+-]?[0-9]+') THEN TRY_CAST(trim(t, ' ') AS INTEGER) END
         AS parsed,
       CASE WHEN g IS NULL OR g = 0 THEN '-' ELSE CAST(g AS VARCHAR) END AS goal_shown,
       CASE WHEN g IS NULL THEN 'N/A' WHEN g = 1 THEN '1 Rep' ELSE CAST(g AS VARCHAR) || ' Reps' END
         AS reps_shown
FROM (SELECT c_custkey, c_name,
             CASE WHEN c_custkey % 3 = 0 THEN ' ' || CAST(c_custkey % 50 AS VARCHAR) || ' '
                  WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 50 AS VARCHAR) || '.0' ELSE '1e1' END AS t,
             CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS INTEGER) END AS g
      FROM customer)""")
def h_text_functions(spark, sf):
    """H1, H2, H9, H13, H14, H15 over customer names and derived texts."""
    c = R.customers(spark, sf)
    k = F.col("c_custkey")
    t = (F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 50).cast("string"), F.lit(" ")))
         .when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit(".0"))).otherwise(F.lit("1e1")))
    g = F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((k % 3).cast("int"))
    x = c.select("c_custkey", "c_name", t.alias("t"), g.alias("g"))
    return x.select("c_custkey",
                    H.js_trim(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("trimmed"),
                    H.lower("c_name").alias("lowered"),
                    H.matches_whole("c_name", S.NAME_PATTERN).alias("name_ok"),
                    H.to_int("t").alias("parsed"),
                    H.goal_display("g").alias("goal_shown"),
                    H.reps_label("g").alias("reps_shown"))
