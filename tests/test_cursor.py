"""I16 (next training day) against a simulation of the reference's loop."""

import random

from regimen.operators import transform as I
from regimen.sources.tables import complete, literal_table


def _simulate(active: dict[int, bool], n: int, cur):
    d = cur
    for _ in range(2 * n + 4):
        if d is not None and active.get(d, False):
            return d
        d = (0 if d is None else d) + 1 if (0 if d is None else d) < n else 1
    return None   # the reference would loop forever


def test_next_day_matches_loop_on_random_routines(spark):
    rnd = random.Random(7)
    tables = {t: [] for t in ("users", "users_current_details", "setup_routines", "setup_days",
                              "setup_sessions", "setup_days_sessions", "setup_session_exercises")}
    expected = {}
    for r in range(300):
        rid = f"r{r}"
        numbers = sorted(rnd.sample(range(1, 14), rnd.randrange(0, 9)))
        active = {d: rnd.random() < 0.35 for d in numbers}
        cur = rnd.choice([None] + list(range(0, 16)))
        tables["users"].append((r, f"user{r}", "*"))
        tables["users_current_details"].append((r, rid, cur if cur else None, 1))
        tables["setup_routines"].append((rid, f"plan{r}", r, True, False))
        for d in numbers:
            tables["setup_days"].append((f"{rid}d{d}", d, rid))
            tables["setup_sessions"].append((f"{rid}s{d}", rid, f"S{d}"))
            tables["setup_days_sessions"].append((f"{rid}j{d}", f"{rid}d{d}", f"{rid}s{d}", 1))
            # a rest day may still hold an exercise, just not with order 1
            order = 1 if active[d] else rnd.choice([None, 2])
            if order:
                tables["setup_session_exercises"].append((f"{rid}x{d}", f"{rid}s{d}", None, "ce", order, None))
        expected[r] = _simulate(active, len(numbers), cur if cur else None)
        if rnd.random() < 0.3:      # a second cursor on the same routine, often on the same day
            other = cur if rnd.random() < 0.5 else rnd.choice([None] + list(range(0, 16)))
            tables["users"].append((1000 + r, f"friend{r}", "*"))
            tables["users_current_details"].append((1000 + r, rid, other if other else None, 1))
            expected[1000 + r] = _simulate(active, len(numbers), other if other else None)
    m = complete(spark, {t: literal_table(spark, t, rows) for t, rows in tables.items()})
    for strategy in ("auto", "split"):
        spark.conf.set("spark.regimen.ordinal.strategy", strategy)
        try:
            got = {row.user_id: row.day_number for row in I.next_training_day(m).collect()}
        finally:
            spark.conf.unset("spark.regimen.ordinal.strategy")
        assert got == expected, strategy


def test_advance_cursor_wraps_on_day_count(spark):
    rows = {
        "users": [(1, "a", "*"), (2, "b", "*"), (3, "c", "*")],
        "users_current_details": [(1, "r", 3, 1), (2, "r", 1, 1), (3, "other", 1, 1)],
        "setup_routines": [("r", "R", 1, True, False), ("other", "O", 3, True, False)],
        # numbers have a gap: count 3, max 5
        "setup_days": [("d1", 1, "r"), ("d2", 2, "r"), ("d5", 5, "r")],
    }
    m = complete(spark, {t: literal_table(spark, t, v) for t, v in rows.items()})
    req = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "user_id int, routine_id string")
    got = {r.user_id: r.current_day_number for r in I.advance_cursor(m, req).collect()}
    assert got == {1: 1, 2: 2, 3: 1}   # user 3's cursor is on another routine: unchanged
