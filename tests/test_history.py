"""Open-workout run grouping with two snapshots of one session (D6) and
history paging with NULL and equal completion dates (F4)."""

import datetime as dt

from regimen.operators import nesting as D
from regimen.operators import paging as P
from regimen.operators import transform as I
from regimen.sources.seed import seed_model


def test_two_open_snapshots_interleave_into_one_exercise(spark):
    m = seed_model(spark)
    req = spark.createDataFrame([(1, 1, "Push-Pull-Legs", 1, "Push"), (2, 1, "Push-Pull-Legs", 1, "Push")],
                                "request_id int, user_id int, routine_name string, day_number int, "
                                "session_name string")
    m = I.append_snapshot(m, I.snapshot(m, req, "t"))
    rows = D.open_session_exercises(m).collect()
    by_ex = {}
    for r in rows:
        by_ex.setdefault((r.exercise_pos, r.exercise_name), []).append((r.set_pos, r.cur_set))
    # both snapshots have the same (name, order) rows: ordered by (order, set) they
    # interleave, and each exercise collects the sets of both snapshots
    assert sorted(by_ex) == [(1, "Push-ups"), (2, "Bench press")]
    assert sorted(by_ex[(1, "Push-ups")]) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert sorted(by_ex[(2, "Bench press")]) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    nested = D.nest_session_exercises(D.open_session_exercises(m)).collect()
    assert len(nested) == 1
    ex = nested[0].exercises
    assert [(e.name, e.exercise_order, [s.cur_set for s in e.sets]) for e in ex] == [
        ("Push-ups", 1, [1, 1, 2, 2]), ("Bench press", 2, [1, 1, 2, 2])]


def test_record_pages_null_first_and_ties_by_id(spark):
    when = dt.datetime(2024, 5, 1, 10, 0, 0)
    logs = [("w1", "P", 1, None, False, when), ("w2", "P", 1, None, False, when),
            ("w3", "P", 1, None, False, None), ("w4", "P", 1, None, False, when + dt.timedelta(days=1))]
    days = [(f"d{k}", 1, f"w{k}", None) for k in range(1, 5)]
    sessions = [(f"s{k}", f"w{k}", "Push", None) for k in range(1, 5)]
    slots = [(f"j{k}", f"d{k}", f"s{k}", 1) for k in range(1, 5)]
    m = seed_model(spark, {"track_routines": logs, "track_days": days, "track_sessions": sessions,
                           "track_days_sessions": slots})
    got = [(r.routine_id, r.record_pos, r.page) for r in
           P.record_pages(m).orderBy("record_pos").collect()]
    assert got == [("w3", 1, 1), ("w4", 2, 1), ("w1", 3, 1), ("w2", 4, 2)]
