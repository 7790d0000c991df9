"""The 16-table relational model: Spark schemas, keys and rules as data.

Key columns are declared as strings (the model's ids are opaque); the driver
adapter keeps the driver's long keys, and every operator is agnostic to the
key type because it only joins and compares keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
WEIGHT = T.DecimalType(6, 2)
TS = T.TimestampType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _st(("id", I), ("username", S), ("password", S)),
    "users_current_details": _st(("user_id", I), ("current_routine_id", S),
                                 ("current_day_number", I), ("current_session_number", I)),
    "exercises": _st(("id", I), ("name", S)),
    "custom_exercises": _st(("id", S), ("name", S), ("user_id", I)),
    "setup_routines": _st(("id", S), ("name", S), ("user_id", I),
                          ("routine_created", B), ("routine_edit_in_progress", B)),
    "setup_days": _st(("id", S), ("day_number", I), ("setup_routine_id", S)),
    "setup_sessions": _st(("id", S), ("setup_routine_id", S), ("name", S)),
    "setup_days_sessions": _st(("id", S), ("day_id", S), ("session_id", S), ("session_order", I)),
    "setup_session_exercises": _st(("id", S), ("setup_session_id", S), ("exercise_id", I),
                                   ("custom_exercise_id", S), ("exercise_order", I),
                                   ("exercise_comment", S)),
    "setup_exercise_details": _st(("id", S), ("setup_session_exercise_id", S), ("weight", WEIGHT),
                                  ("cur_set", I), ("reps_goal", I), ("myo_order", I)),
    "track_routines": _st(("id", S), ("name", S), ("user_id", I), ("setup_id", S),
                          ("in_progress", B), ("completion_date", TS)),
    "track_days": _st(("id", S), ("day_number", I), ("track_routine_id", S), ("setup_id", S)),
    "track_sessions": _st(("id", S), ("track_routine_id", S), ("name", S), ("setup_id", S)),
    "track_days_sessions": _st(("id", S), ("day_id", S), ("session_id", S), ("session_order", I)),
    "track_session_exercises": _st(("id", S), ("track_session_id", S), ("exercise_id", I),
                                   ("custom_exercise_id", S), ("exercise_order", I),
                                   ("exercise_comment", S), ("setup_id", S)),
    "track_exercise_details": _st(("id", S), ("track_session_exercise_id", S), ("weight", WEIGHT),
                                  ("cur_set", I), ("reps_goal", I), ("reps_done", I),
                                  ("myo_order", I), ("setup_id", S)),
}

TABLES = tuple(SCHEMAS)

# Rules of the model, as data. Each entry names the table and columns; the
# quality operators (J1-J5) turn them into violation reports.
PRIMARY_KEYS = {t: ("user_id",) if t == "users_current_details" else ("id",) for t in TABLES}

# unique constraints; NULL never collides (PostgreSQL semantics)
UNIQUE = [
    ("exercises", ("name",)),
    ("users", ("username",)),
    ("custom_exercises", ("user_id", "name")),
    ("setup_days", ("day_number", "setup_routine_id")),
    ("setup_days_sessions", ("day_id", "session_order")),
    ("setup_session_exercises", ("setup_session_id", "exercise_order")),
    ("setup_exercise_details", ("setup_session_exercise_id", "cur_set", "myo_order")),
    ("track_days", ("day_number", "track_routine_id")),
    ("track_days_sessions", ("day_id", "session_order")),
    ("track_session_exercises", ("track_session_id", "exercise_order")),
    ("track_exercise_details", ("track_session_exercise_id", "cur_set", "myo_order")),
]

# case-insensitive unique (owner, LOWER(name)); many NULL names allowed
UNIQUE_LOWER = [
    ("exercises", None, "name"),
    ("setup_routines", "user_id", "name"),
    ("setup_sessions", "setup_routine_id", "name"),
    ("track_sessions", "track_routine_id", "name"),
]

# (child table, child column, parent table, parent column, on delete)
FOREIGN_KEYS = [
    ("custom_exercises", "user_id", "users", "id", "cascade"),
    ("users_current_details", "user_id", "users", "id", "cascade"),
    ("users_current_details", "current_routine_id", "setup_routines", "id", "restrict"),
    ("setup_routines", "user_id", "users", "id", "cascade"),
    ("setup_days", "setup_routine_id", "setup_routines", "id", "cascade"),
    ("setup_sessions", "setup_routine_id", "setup_routines", "id", "cascade"),
    ("setup_days_sessions", "day_id", "setup_days", "id", "cascade"),
    ("setup_days_sessions", "session_id", "setup_sessions", "id", "cascade"),
    ("setup_session_exercises", "setup_session_id", "setup_sessions", "id", "cascade"),
    ("setup_session_exercises", "exercise_id", "exercises", "id", "cascade"),
    ("setup_session_exercises", "custom_exercise_id", "custom_exercises", "id", "cascade"),
    ("setup_exercise_details", "setup_session_exercise_id", "setup_session_exercises", "id", "cascade"),
    ("track_routines", "user_id", "users", "id", "cascade"),
    ("track_routines", "setup_id", "setup_routines", "id", "restrict"),
    ("track_days", "track_routine_id", "track_routines", "id", "cascade"),
    ("track_sessions", "track_routine_id", "track_routines", "id", "cascade"),
    ("track_days_sessions", "day_id", "track_days", "id", "cascade"),
    ("track_days_sessions", "session_id", "track_sessions", "id", "cascade"),
    ("track_session_exercises", "track_session_id", "track_sessions", "id", "cascade"),
    ("track_session_exercises", "exercise_id", "exercises", "id", "cascade"),
    ("track_session_exercises", "custom_exercise_id", "custom_exercises", "id", "cascade"),
    ("track_exercise_details", "track_session_exercise_id", "track_session_exercises", "id", "cascade"),
]

# CHECK constraints: (table, column, operator, bound); NULL passes
CHECKS = [
    ("setup_days", "day_number", ">", 0),
    ("setup_days_sessions", "session_order", ">", 0),
    ("users_current_details", "current_day_number", ">", 0),
    ("users_current_details", "current_session_number", ">", 0),
    ("setup_session_exercises", "exercise_order", ">", 0),
    ("setup_exercise_details", "cur_set", ">", 0),
    ("setup_exercise_details", "reps_goal", ">", 0),
    ("setup_exercise_details", "myo_order", ">", 0),
    ("track_days", "day_number", ">", 0),
    ("track_days_sessions", "session_order", ">", 0),
    ("track_session_exercises", "exercise_order", ">", 0),
    ("track_exercise_details", "cur_set", ">", 0),
    ("track_exercise_details", "reps_goal", ">", 0),
    ("track_exercise_details", "reps_done", ">=", 0),
    ("track_exercise_details", "myo_order", ">", 0),
]

NOT_NULL = [
    ("exercises", "name"), ("users", "username"), ("users", "password"), ("custom_exercises", "name"),
    ("custom_exercises", "user_id"), ("setup_routines", "user_id"),
    ("setup_days", "day_number"), ("setup_days", "setup_routine_id"),
    ("setup_sessions", "setup_routine_id"), ("setup_sessions", "name"),
    ("setup_days_sessions", "day_id"), ("setup_days_sessions", "session_id"),
    ("setup_days_sessions", "session_order"),
    ("setup_session_exercises", "setup_session_id"), ("setup_session_exercises", "exercise_order"),
    ("setup_exercise_details", "setup_session_exercise_id"), ("setup_exercise_details", "cur_set"),
    ("track_routines", "name"), ("track_routines", "user_id"), ("track_days", "day_number"), ("track_days", "track_routine_id"),
    ("track_sessions", "track_routine_id"), ("track_sessions", "name"),
    ("track_days_sessions", "day_id"), ("track_days_sessions", "session_id"),
    ("track_days_sessions", "session_order"),
    ("track_session_exercises", "track_session_id"), ("track_session_exercises", "exercise_order"),
    ("track_exercise_details", "track_session_exercise_id"), ("track_exercise_details", "cur_set"),
]

# Fixed values of the reference's input rules and display (must match it).
NAME_PATTERN = r"\A[a-zA-Z0-9()+\- ]+\z"
NAME_MAX = 255
ROUTINE_NAME_MAX = 100
DAYS_PER_PAGE = 3
RECORDS_PER_PAGE = 3
DISPLAY_TZ = "America/Los_Angeles"
DATE_FORMAT = "MM/dd/yyyy"
