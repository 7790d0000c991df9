"""Table transforms: ordinals stay dense, cascades leave no orphans, batches."""

from pyspark.sql import functions as F

from regimen.operators import quality as J
from regimen.operators import transform as I
from regimen.sources import schema as S
from regimen.sources.seed import seed_model


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_delete_two_days_shifts_by_deletes_below(spark):
    m = seed_model(spark)
    new = I.delete_days(m, _df(spark, [("routine:ppl", 2), ("routine:ppl", 5), ("routine:ppl", 9)],
                               "routine_id string, day_number int"))
    got = {r.id: r.day_number for r in new["setup_days"].collect()}
    assert got == {"day:1": 1, "day:3": 2, "day:4": 3, "day:6": 4, "day:7": 5}
    assert new["setup_days_sessions"].filter(F.col("day_id").isin("day:2", "day:5")).count() == 0


def test_append_several_exercises_per_session_follow_seq(spark):
    m = seed_model(spark)
    req = _df(spark, [(1, 2, "ses:Push", "ce:Squat"), (2, 1, "ses:Push", "ce:Push-ups"),
                      (3, 1, "ses:Rest1", "ce:Squat")],
              "request_id int, seq int, setup_session_id string, custom_exercise_id string")
    new = I.add_session_exercises(m, req, "t")
    got = {(r.setup_session_id, r.custom_exercise_id): r.exercise_order
           for r in new["setup_session_exercises"].collect()}
    assert got == {("ses:Push", "ce:Push-ups"): 3, ("ses:Push", "ce:Squat"): 4, ("ses:Rest1", "ce:Squat"): 1}
    assert new["setup_exercise_details"].filter("cur_set = 1").count() == 3


def test_reorder_valid_and_invalid(spark):
    m = seed_model(spark)
    req = _df(spark, [("ses:Push", 1, "2"), ("ses:Push", 2, "1"),          # valid swap
                      ("ses:Pull", 1, "1"), ("ses:Pull", 2, "1")],         # duplicate
              "setup_session_id string, old_order int, new_order string")
    out, report = I.reorder(m.setup_session_exercises, "setup_session_id", "exercise_order", req)
    got = {r.id: r.exercise_order for r in out.collect()}
    assert got["sse:Push:1"] == 2 and got["sse:Push:2"] == 1
    assert got["sse:Pull:1"] == 1 and got["sse:Pull:2"] == 2
    reasons = {r.setup_session_id: r.reason for r in report.collect()}
    assert reasons == {"ses:Push": None, "ses:Pull": "duplicate order"}


def test_reorder_rejects_incomplete_and_non_integer(spark):
    m = seed_model(spark)
    req = _df(spark, [("ses:Push", 1, "1"), ("ses:Pull", 1, "1e1"), ("ses:Pull", 2, "1")],
              "setup_session_id string, old_order int, new_order string")
    _, report = I.reorder(m.setup_session_exercises, "setup_session_id", "exercise_order", req)
    reasons = {r.setup_session_id: r.reason for r in report.collect()}
    assert reasons == {"ses:Push": "incomplete permutation", "ses:Pull": "not an integer"}


def test_reorder_plans_agree_on_random_requests(spark):
    import random
    rnd = random.Random(11)
    kids, reqs = [], []
    for p in range(60):
        n = rnd.randrange(0, 5)
        kids += [(f"x{p}:{o}", f"p{p}", o) for o in range(1, n + 1)]
        perm = list(range(1, n + 1))
        rnd.shuffle(perm)
        kind = rnd.choice(["ok", "dup", "range", "text", "partial", "none"])
        for old, new in zip(range(1, n + 1), perm):
            val = {"dup": "1", "range": str(new + n), "text": f"{new}.0"}.get(kind, str(new))
            if kind == "partial" and old == n:
                continue
            if kind != "none":
                reqs.append((f"p{p}", old, val))
    children = _df(spark, kids, "id string, parent string, ord int")
    requests = _df(spark, reqs, "parent string, old_order int, new_order string")
    got = {}
    for strategy in ("auto", "split"):
        spark.conf.set("spark.regimen.ordinal.strategy", strategy)
        try:
            out, report = I.reorder(children, "parent", "ord", requests)
            got[strategy] = (sorted(out.collect()), sorted(report.collect()))
        finally:
            spark.conf.unset("spark.regimen.ordinal.strategy")
    assert got["auto"] == got["split"]


def test_reorder_plans_agree_on_duplicate_orders_and_null_parents(spark):
    kids = [("a1", "dup", 1), ("a2", "dup", 1), ("a3", "dup", 2), ("b1", None, 1), ("b2", None, 2), ("c1", "nil", 1), ("c2", "nil", None), ("d1", "ok", 1), ("d2", "ok", 2),
            ("e1", "both", 1), ("e2", "both", 1)]
    reqs = [("dup", 1, "2"), ("dup", 2, "1"), (None, 1, "2"), (None, 2, "1"), ("nil", 1, "2"), ("nil", None, "1"), ("ok", 1, "2"), ("ok", 2, "1"),
            ("none", 1, "1"), ("both", 1, "1"), ("both", 1, "2"), ("nul2", None, "1"), ("nul2", None, "2")]
    children, requests = _df(spark, kids, "id string, parent string, ord int"), _df(spark, reqs, "parent string, old_order int, new_order string")
    got = {}
    for strategy in ("window", "split"):
        spark.conf.set("spark.regimen.ordinal.strategy", strategy)
        try:
            out, report = I.reorder(children, "parent", "ord", requests)
            checked = I.reorder_check(children, "parent", "ord", requests)
            key = lambda r: tuple(str(x) for x in r)
            got[strategy] = (sorted(out.collect(), key=key), sorted(report.collect(), key=key), sorted(checked.collect(), key=key))
        finally:
            spark.conf.unset("spark.regimen.ordinal.strategy")
    assert got["window"] == got["split"]
    told = {r["parent"]: (r["listed"], r["n"], r["reason"]) for r in got["split"][1]}
    assert told == {"dup": (2, 3, "incomplete permutation"), None: (2, 2, None), "nil": (2, 2, None), "ok": (2, 2, None), "none": (1, 0, "order out of range"),
                    "both": (2, 2, "unknown exercise"), "nul2": (2, 0, "order out of range")}
    assert {r["id"]: r["ord"] for r in got["split"][0]} == {"a1": 1, "a2": 1, "a3": 2, "b1": 2, "b2": 1, "c1": 2, "c2": 1, "d1": 2, "d2": 1, "e1": 1, "e2": 1}


def test_cascade_delete_leaves_no_orphans(spark):
    m = seed_model(spark)
    new = I.delete_plan_tree(m, _df(spark, [("routine:ppl",)], "id string"))
    m2 = m.replace(**new)
    assert all(m2[t].count() == 0 for t in new)
    fk = [J.dangling_references(m2[t], c, m2[pt], pc, t) for t, c, pt, pc, _ in S.FOREIGN_KEYS]
    assert sum(x.count() for x in fk) == 0


def test_delete_session_cascades_slots_exercises_sets(spark):
    m = seed_model(spark)
    new = I.delete_sessions(m, _df(spark, [("routine:ppl", "Push")], "routine_id string, session_name string"))
    assert new["setup_sessions"].count() == 6
    assert new["setup_days_sessions"].count() == 6
    assert new["setup_session_exercises"].count() == 3
    assert new["setup_exercise_details"].count() == 3


def test_restrict_check_blocks_current_routine(spark):
    m = seed_model(spark, {"users_current_details": [(9, "routine:ppl", 1, 1)]})
    check = I.restrict_check(m, _df(spark, [("routine:ppl",), ("routine:none",)], "id string")).collect()
    assert {r.id: r.blocked_by for r in check} == {"routine:ppl": "current routine", "routine:none": None}


def test_rename_case_only_is_allowed_and_clash_refused(spark):
    m = seed_model(spark)
    req = _df(spark, [(1, 1, "ses:Push", "PUSH"), (2, 1, "ses:Pull", "legs"), (3, 1, "ses:Rest1", "Bad#")],
              "request_id int, seq int, session_id string, new_name string")
    new, rejected = I.rename_sessions(m, req)
    names = {r.id: r.name for r in new.collect()}
    assert names["ses:Push"] == "PUSH" and names["ses:Pull"] == "Pull"
    assert {r.request_id: r.reason for r in rejected.collect()} == {
        2: "name already used",
        3: "name:bad_character"}


def test_create_named_dedupes_in_batch(spark):
    m = seed_model(spark)
    req = _df(spark, [(1, 1, "routine:ppl", " Core "), (2, 2, "routine:ppl", "core"),
                      (3, 3, "routine:ppl", "push"), (4, 4, "routine:ppl", "")],
              "request_id int, seq int, setup_routine_id string, name string")
    new, rejected = I.create_named(m.setup_sessions, "setup_routine_id", req, "t", "session")
    assert [r.name for r in new.collect()] == ["Core"]
    assert {r.request_id: r.reason for r in rejected.collect()} == {
        2: "duplicate in batch", 3: "name already used", 4: "name:empty"}


def test_select_routine_resets_cursor_only_on_change(spark):
    m = seed_model(spark, {"setup_routines": [("routine:b", "B", 1, True, False)],
                           "users_current_details": []})
    m = m.replace(users_current_details=spark.createDataFrame(
        [(1, "routine:ppl", 4, 1), (2, None, 3, 1)], S.SCHEMAS["users_current_details"]))
    req = _df(spark, [(1, "Push-Pull-Legs", 1), (2, "B", 1)], "user_id int, routine_name string, seq int")
    got = {r.user_id: (r.current_routine_id, r.current_day_number) for r in I.select_routine(m, req).collect()}
    # user 1 re-selects the current routine; user 2 names a routine that is not theirs
    assert got[1] == ("routine:ppl", 4) and got[2] == (None, 3)
    req = _df(spark, [(1, "Push-Pull-Legs", 1), (1, "B", 2)], "user_id int, routine_name string, seq int")
    got = {r.user_id: (r.current_routine_id, r.current_day_number) for r in I.select_routine(m, req).collect()}
    assert got[1] == ("routine:b", 1)       # the last request wins and the cursor resets


def test_complete_workouts_stamps_closes_and_advances(spark):
    m = seed_model(spark, {"users_current_details": [(1, "routine:ppl", 7, 1)]})
    m = m.replace(users_current_details=m.users_current_details.filter("current_routine_id IS NOT NULL"))
    req = _df(spark, [(1, 1, "Push-Pull-Legs", 1, "Push")],
              "request_id int, user_id int, routine_name string, day_number int, session_name string")
    m = I.append_snapshot(m, I.snapshot(m, req, "t"))
    out = I.complete_workouts(m, _df(spark, [(1, "Push-Pull-Legs")], "user_id int, routine_name string"),
                              "2024-06-01 12:00:00")
    tr = out["track_routines"].first()
    assert tr.in_progress is False and str(tr.completion_date) == "2024-06-01 12:00:00"
    assert out["users_current_details"].first().current_day_number == 1   # 7 of 7 wraps
