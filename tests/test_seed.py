"""Exact-row tests on the seed plan (golden answers derived by hand)."""

from pyspark.sql import functions as F

from regimen.operators import nesting as D
from regimen.operators import outline as C
from regimen.operators import paging as P
from regimen.operators import transform as I
from regimen.sources.seed import seed_model


def test_day_outline(spark):
    flat = D.day_outline(seed_model(spark))
    nested = D.nest_day_outline(flat).orderBy("day_number").collect()
    got = [(r.day_number, [(s.name, list(s.exercises)) for s in r.sessions]) for r in nested]
    assert got == [
        (1, [("Push", ["Push-ups", "Bench press"])]),
        (2, [("Rest1", [])]),
        (3, [("Pull", ["Single Arm Curls(L)", "Single Arm Curls(R)"])]),
        (4, [("Rest2", [])]),
        (5, [("Legs", ["Squat"])]),
        (6, [("Rest3", [])]),
        (7, [("Rest4", [])]),
    ]


def test_outline_on_empty_catalog_is_empty(spark):
    # the outline joins the shared exercise table, which the seed leaves empty
    assert C.plan_outline(seed_model(spark)).count() == 0


def _with_cursors(spark, days):
    users = [(10 + d, f"u{d}", "*") for d in days]
    cursors = [(10 + d, "routine:ppl", d, 1) for d in days]
    return seed_model(spark, {"users": users, "users_current_details": cursors})


def test_next_training_day(spark):
    m = _with_cursors(spark, range(1, 8))
    got = {r.user_id - 10: r.day_number for r in I.next_training_day(m).collect()}
    assert [got[d] for d in range(1, 8)] == [1, 3, 3, 5, 5, 1, 1]


def test_whats_next_names_the_session(spark):
    m = _with_cursors(spark, [2])
    row = I.whats_next(m).filter("user_id = 12").first()
    assert (row.routine_name, row.day_number, row.session_name) == ("Push-Pull-Legs", 3, "Pull")


def _counts(new):
    return [new[t].count() for t in I.TRACK_TABLES]


def test_snapshot_one_day(spark):
    m = seed_model(spark)
    req = spark.createDataFrame([(1, 1, "Push-Pull-Legs", 1, "Push")],
                                "request_id int, user_id int, routine_name string, day_number int, "
                                "session_name string")
    new = I.snapshot(m, req, "t")
    assert _counts(new) == [1, 1, 1, 1, 2, 4]
    assert new["track_exercise_details"].filter(F.col("reps_done").isNotNull()).count() == 0
    # children point at the new parents
    ex_ids = {r.id for r in new["track_session_exercises"].collect()}
    assert {r.track_session_exercise_id for r in new["track_exercise_details"].collect()} == ex_ids


def test_snapshot_whole_routine_and_retry_is_identical(spark):
    m = seed_model(spark)
    req = spark.createDataFrame([(1, 1, "Push-Pull-Legs")], "request_id int, user_id int, routine_name string")
    a = I.snapshot(m, req, "t", whole_routine=True)
    b = I.snapshot(m, req, "t", whole_routine=True)
    assert _counts(a) == [1, 7, 7, 7, 5, 7]
    for t in I.TRACK_TABLES:
        assert sorted(a[t].collect()) == sorted(b[t].collect())


def test_delete_day_shifts_and_pages(spark):
    m = seed_model(spark)
    before = P.day_page_counts(m).first().total_pages
    new = I.delete_days(m, spark.createDataFrame([("routine:ppl", 2)], "routine_id string, day_number int"))
    m2 = m.replace(**new)
    days = {r.day_number: r.id for r in m2.setup_days.collect()}
    assert sorted(days) == [1, 2, 3, 4, 5, 6]
    names = {r.day_number: r.session_name for r in C.days_with_sessions(m2).collect()}
    assert names[2] == "Pull" and names[4] == "Legs"
    assert (before, P.day_page_counts(m2).first().total_pages) == (3, 2)


def test_rest_flags(spark):
    m = seed_model(spark)
    cur = spark.createDataFrame([("routine:ppl", d, 1) for d in range(1, 8)],
                                "routine_id string, day_number int, session_order int")
    rest = {r.day_number: r.is_rest for r in C.rest_flags(m, cur).collect()}
    assert [rest[d] for d in range(1, 8)] == [False, True, False, True, False, True, True]
