"""DuckDB SQL for each registered query (the correctness oracle).

``MODEL`` is the driver adapter written as CTEs over the driver views; each
oracle is ``MODEL`` followed by its own CTEs and final SELECT. It is a second,
independent formulation (plain SQL windows, lag, string_agg), not a
translation of the Spark code.
"""

from __future__ import annotations

MODEL = r"""
users AS (SELECT c_custkey AS id, c_name AS username, '*' AS password FROM customer),
exercises AS (SELECT p_partkey AS id, p_name AS name FROM part),
part_owner AS (
  SELECT l_partkey, arg_min(o_custkey, o_orderkey) AS user_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
custom_exercises AS (
  SELECT p_partkey AS id, p_name AS name, po.user_id
  FROM part LEFT JOIN part_owner po ON po.l_partkey = p_partkey),
setup_routines AS (
  SELECT c_custkey AS id, 'Plan ' || CAST(c_custkey AS VARCHAR) AS name, c_custkey AS user_id,
         c_custkey % 17 <> 0 AS routine_created, FALSE AS routine_edit_in_progress FROM customer),
day_numbers AS (
  SELECT o_orderkey, o_custkey,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER)
           AS day_number
  FROM orders),
setup_days AS (SELECT o_orderkey AS id, day_number, o_custkey AS setup_routine_id FROM day_numbers),
setup_sessions AS (
  SELECT o_orderkey AS id, o_custkey AS setup_routine_id,
         o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
setup_days_sessions AS (
  SELECT o_orderkey AS id, o_orderkey AS day_id, o_orderkey AS session_id, 1 AS session_order
  FROM orders),
numbered_lines AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_linestatus,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST,
              l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
              l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
              l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST)
              AS INTEGER) AS exercise_order
  FROM lineitem),
lines AS (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(exercise_order AS VARCHAR) AS line_id
          FROM numbered_lines),
setup_session_exercises AS (
  SELECT line_id AS id, l_orderkey AS setup_session_id, l_partkey AS exercise_id,
         l_partkey AS custom_exercise_id, exercise_order, CAST(NULL AS VARCHAR) AS exercise_comment
  FROM lines),
setup_exercise_details AS (
  SELECT line_id AS id, line_id AS setup_session_exercise_id,
         CAST(l_quantity * 0.5 AS DECIMAL(6,2)) AS weight, 1 AS cur_set,
         CAST(floor(l_quantity) AS INTEGER) AS reps_goal, CAST(NULL AS INTEGER) AS myo_order
  FROM lines),
n_days AS (SELECT o_custkey, count(*) AS n_days FROM orders GROUP BY o_custkey),
users_current_details AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS current_routine_id,
         CAST(c_custkey % n_days + 1 AS INTEGER) AS current_day_number, 1 AS current_session_number
  FROM customer LEFT JOIN n_days ON c_custkey = o_custkey),
track_routines AS (
  SELECT o_orderkey AS id, 'Plan ' || CAST(o_custkey AS VARCHAR) AS name, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 11 = 0 THEN o_custkey END AS setup_id,
         o_orderstatus <> 'F' AS in_progress,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completion_date
  FROM orders),
track_days AS (
  SELECT o_orderkey AS id, day_number, o_orderkey AS track_routine_id,
         CAST(NULL AS BIGINT) AS setup_id FROM day_numbers),
track_sessions AS (
  SELECT o_orderkey AS id, o_orderkey AS track_routine_id,
         o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS name,
         CAST(NULL AS BIGINT) AS setup_id FROM orders),
track_days_sessions AS (SELECT * FROM setup_days_sessions),
track_session_exercises AS (
  SELECT line_id AS id, l_orderkey AS track_session_id, l_partkey AS exercise_id,
         l_partkey AS custom_exercise_id, exercise_order, CAST(NULL AS VARCHAR) AS exercise_comment,
         CAST(NULL AS VARCHAR) AS setup_id
  FROM lines),
track_exercise_details AS (
  SELECT line_id AS id, line_id AS track_session_exercise_id,
         CAST(l_quantity * 0.5 AS DECIMAL(6,2)) AS weight, 1 AS cur_set,
         CAST(floor(l_quantity) AS INTEGER) AS reps_goal,
         CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity * (1.0 - l_discount)) AS INTEGER) END
           AS reps_done,
         CAST(NULL AS INTEGER) AS myo_order, CAST(NULL AS VARCHAR) AS setup_id
  FROM lines)
"""


# The same facts flat, straight over the driver tables: the outlines' oracles read these instead of
# joining the model's tables again. The denser fixture has its own text with the same names.
FLAT = r"""
plan_days AS (
  SELECT o_custkey AS routine_id, o_orderkey AS day_id, day_number, o_orderkey AS slot_id, 1 AS session_order,
         o_orderkey AS session_id, o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS session_name
  FROM day_numbers JOIN orders USING (o_orderkey, o_custkey)),
part_lines AS (
  SELECT l.*, l_orderkey AS session_id, line_id AS sse_id, p_name AS exercise_name, CAST(NULL AS VARCHAR) AS comment
  FROM lines l LEFT JOIN part ON p_partkey = l_partkey),
part_sets AS (
  SELECT *, line_id AS set_id, 1 AS cur_set, CAST(floor(l_quantity) AS INTEGER) AS reps_goal, CAST(l_quantity * 0.5 AS DOUBLE) AS weight,
         CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity * (1.0 - l_discount)) AS INTEGER) END AS reps_done
  FROM part_lines),
log_days AS (
  SELECT o_custkey AS user_id, o_orderkey AS workout_id, 'Plan ' || CAST(o_custkey AS VARCHAR) AS workout_name,
         o_orderstatus <> 'F' AS is_open, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completion_date,
         day_number, o_orderkey AS session_id, o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS session_name
  FROM day_numbers JOIN orders USING (o_orderkey, o_custkey))
"""

DENSE = r"""
users AS (SELECT c_custkey AS id, c_name AS username, '*' AS password FROM customer),
exercises AS (SELECT p_partkey AS id, p_name AS name FROM part),
part_owner AS (
  SELECT l_partkey, arg_min(o_custkey, o_orderkey) AS user_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
custom_exercises AS (
  SELECT p_partkey AS id, p_name AS name, po.user_id
  FROM part LEFT JOIN part_owner po ON po.l_partkey = p_partkey),
setup_routines AS (
  SELECT c_custkey AS id, 'Plan ' || CAST(c_custkey AS VARCHAR) AS name, c_custkey AS user_id,
         c_custkey % 17 <> 0 AS routine_created, FALSE AS routine_edit_in_progress FROM customer
  UNION ALL SELECT c_custkey + 1000000000, NULL, c_custkey, FALSE, FALSE FROM customer WHERE c_custkey % 19 = 0
  UNION ALL SELECT c_custkey + 2000000000, NULL, c_custkey, FALSE, FALSE FROM customer WHERE c_custkey % 38 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rk FROM orders),
paired AS (
  SELECT *, CAST(floor((rk + 1) / 2) AS INTEGER) AS day_no,
         CASE WHEN rk % 2 = 1 THEN o_orderkey
              ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY rk) END AS day_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderpriority
              ELSE o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) END AS title
  FROM ranked),
setup_days AS (
  SELECT o_orderkey AS id, day_no AS day_number, o_custkey AS setup_routine_id FROM paired WHERE rk % 2 = 1
  UNION ALL SELECT -o_custkey - 1, CAST(max(day_no) + 1 AS INTEGER), o_custkey FROM paired WHERE o_custkey % 5 = 0 GROUP BY o_custkey),
setup_sessions AS (SELECT o_orderkey AS id, o_custkey AS setup_routine_id, title AS name FROM paired),
setup_days_sessions AS (
  SELECT o_orderkey AS id, day_id, o_orderkey AS session_id,
         CAST(CASE WHEN o_orderkey % 83 = 0 THEN 0 ELSE 2 - rk % 2 END AS INTEGER) AS session_order FROM paired
  UNION ALL SELECT -o_orderkey, day_id, o_orderkey, 3 FROM paired WHERE o_orderkey % 10 = 3 AND rk % 2 = 1
  UNION ALL SELECT o_orderkey + 1000000000, day_id, -1, 4 FROM paired WHERE o_orderkey % 89 = 0),
numbered_lines AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST,
              l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
              l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
              l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST)
              AS INTEGER) AS exercise_order
  FROM lineitem),
lines AS (
  SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(exercise_order AS VARCHAR) AS line_id,
         CASE WHEN l_linenumber % 2 = 0 THEN 'note ' || CAST(l_linenumber AS VARCHAR) END AS comment
  FROM numbered_lines),
line_sets AS (
  SELECT *, line_id || '.' || CAST(cur_set AS VARCHAR) AS set_id, CAST(l_quantity * 0.5 AS DECIMAL(6,2)) AS weight,
         CAST(CASE WHEN floor(l_quantity) = 13 THEN 0 ELSE floor(l_quantity) END AS INTEGER) AS reps_goal,
         CASE WHEN l_linestatus = 'F' AND cur_set = 1 THEN CAST(floor(l_quantity * (1.0 - l_discount)) AS INTEGER) END AS reps_done
  FROM (SELECT *, 1 AS cur_set FROM lines UNION ALL SELECT *, 2 AS cur_set FROM lines WHERE l_quantity > 25) two),
setup_session_exercises AS (
  SELECT line_id AS id, l_orderkey AS setup_session_id, l_partkey AS exercise_id, l_partkey AS custom_exercise_id,
         exercise_order, comment AS exercise_comment FROM lines),
setup_exercise_details AS (
  SELECT set_id AS id, line_id AS setup_session_exercise_id, weight, cur_set, reps_goal, CAST(NULL AS INTEGER) AS myo_order FROM line_sets),
n_days AS (SELECT o_custkey, count(*) AS n_days FROM orders GROUP BY o_custkey),
users_current_details AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS current_routine_id,
         CAST(c_custkey % n_days + 1 AS INTEGER) AS current_day_number, 1 AS current_session_number
  FROM customer LEFT JOIN n_days ON c_custkey = o_custkey),
track_routines AS (
  SELECT o_orderkey AS id, 'Plan ' || CAST(o_custkey AS VARCHAR) AS name, o_custkey AS user_id,
         CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS setup_id, o_orderstatus <> 'F' AS in_progress,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completion_date FROM orders),
track_days AS (
  SELECT o_orderkey AS id, rk AS day_number, o_orderkey AS track_routine_id, CASE WHEN o_orderkey % 2 = 0 THEN day_id END AS setup_id FROM paired),
track_sessions AS (
  SELECT o_orderkey AS id, o_orderkey AS track_routine_id, coalesce(title, o_orderpriority) AS name,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS setup_id FROM paired),
track_days_sessions AS (
  SELECT o_orderkey AS id, o_orderkey AS day_id, o_orderkey AS session_id, 1 AS session_order FROM orders),
track_session_exercises AS (
  SELECT line_id AS id, l_orderkey AS track_session_id, l_partkey AS exercise_id, l_partkey AS custom_exercise_id,
         exercise_order, comment AS exercise_comment, CASE WHEN l_orderkey % 2 = 0 THEN line_id END AS setup_id FROM lines),
track_exercise_details AS (
  SELECT set_id AS id, line_id AS track_session_exercise_id, weight, cur_set, reps_goal, reps_done, CAST(NULL AS INTEGER) AS myo_order,
         CASE WHEN l_orderkey % 2 = 0 THEN set_id END AS setup_id FROM line_sets)
"""

FLAT_DENSE = r"""
plan_days AS (
  SELECT o_custkey AS routine_id, day_id, day_no AS day_number, o_orderkey AS slot_id,
         CAST(CASE WHEN o_orderkey % 83 = 0 THEN 0 ELSE 2 - rk % 2 END AS INTEGER) AS session_order, o_orderkey AS session_id, title AS session_name
  FROM paired
  UNION ALL SELECT o_custkey, day_id, day_no, -o_orderkey, 3, o_orderkey, title FROM paired WHERE o_orderkey % 10 = 3 AND rk % 2 = 1
  UNION ALL SELECT o_custkey, day_id, day_no, o_orderkey + 1000000000, 4, NULL, NULL FROM paired WHERE o_orderkey % 89 = 0
  UNION ALL SELECT o_custkey, -o_custkey - 1, CAST(max(day_no) + 1 AS INTEGER), NULL, NULL, NULL, NULL FROM paired
            WHERE o_custkey % 5 = 0 GROUP BY o_custkey),
part_lines AS (
  SELECT l.*, l_orderkey AS session_id, line_id AS sse_id, p_name AS exercise_name
  FROM lines l LEFT JOIN part ON p_partkey = l_partkey),
part_sets AS (
  SELECT s.* EXCLUDE (weight), CAST(s.weight AS DOUBLE) AS weight, l_orderkey AS session_id, line_id AS sse_id, p_name AS exercise_name
  FROM line_sets s LEFT JOIN part ON p_partkey = l_partkey),
log_days AS (
  SELECT o_custkey AS user_id, o_orderkey AS workout_id, 'Plan ' || CAST(o_custkey AS VARCHAR) AS workout_name,
         o_orderstatus <> 'F' AS is_open, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completion_date,
         rk AS day_number, o_orderkey AS session_id, coalesce(title, o_orderpriority) AS session_name
  FROM paired)
"""


def with_model(body: str, dense: bool = False) -> str:
    """``body`` is ``[more CTEs,] SELECT ...``; CTEs in body must start with a name."""
    body = body.strip()
    model = (DENSE + "," + FLAT_DENSE if dense else MODEL + "," + FLAT).rstrip()
    return "WITH" + model + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, dense: bool = False) -> None:
    ORACLE[name] = with_model(body, dense)
