"""The seed plan as literal rows (A2): one user, a 7-day push/pull/legs routine.

Ids are readable strings. The seed's user cursor is all NULL, as after sign-up.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession

from regimen.sources.tables import Model, complete, literal_table

# Fixed values of the seed plan.
USERS = ["admin", "developer", "bob"]
EXERCISES = ["Push-ups", "Bench press", "Single Arm Curls(L)", "Single Arm Curls(R)", "Squat"]
ROUTINE = "Push-Pull-Legs"
SESSIONS = ["Push", "Rest1", "Pull", "Rest2", "Legs", "Rest3", "Rest4"]
# (session, exercise, exercise_order)
SESSION_EXERCISES = [("Push", "Push-ups", 1), ("Push", "Bench press", 2),
                     ("Pull", "Single Arm Curls(L)", 1), ("Pull", "Single Arm Curls(R)", 2),
                     ("Legs", "Squat", 1)]
# (exercise, cur_set, reps_goal)
SETS = [("Push-ups", 1, 40), ("Push-ups", 2, 30), ("Single Arm Curls(L)", 1, 12),
        ("Single Arm Curls(R)", 1, 12), ("Bench press", 1, 10), ("Bench press", 2, 10),
        ("Squat", 1, 20)]


def _key(*parts) -> str:
    return ":".join(str(p) for p in parts)


def seed_rows() -> dict[str, list[tuple]]:
    rid = "routine:ppl"
    sse_id = {ex: _key("sse", ses, order) for ses, ex, order in SESSION_EXERCISES}
    return {
        "users": [(i + 1, name, "*") for i, name in enumerate(USERS)],
        "users_current_details": [(i + 1, None, None, None) for i in range(len(USERS))],
        "custom_exercises": [(_key("ce", name), name, 1) for name in EXERCISES],
        "setup_routines": [(rid, ROUTINE, 1, True, False)],
        "setup_days": [(_key("day", d), d, rid) for d in range(1, 8)],
        "setup_sessions": [(_key("ses", name), rid, name) for name in SESSIONS],
        "setup_days_sessions": [(_key("ds", d), _key("day", d), _key("ses", name), 1)
                                for d, name in enumerate(SESSIONS, start=1)],
        "setup_session_exercises": [(sse_id[ex], _key("ses", ses), None, _key("ce", ex), order, None)
                                    for ses, ex, order in SESSION_EXERCISES],
        "setup_exercise_details": [(_key("set", ex, s), sse_id[ex], None, s, goal, None)
                                   for ex, s, goal in SETS],
    }


def seed_model(spark: SparkSession, extra: dict[str, list[tuple]] | None = None) -> Model:
    """Seed plan; ``extra`` rows are appended per table (edge cases in tests)."""
    rows = seed_rows()
    for name, more in (extra or {}).items():
        rows[name] = rows.get(name, []) + list(more)
    return complete(spark, {t: literal_table(spark, t, r) for t, r in rows.items()})


def weight(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))
