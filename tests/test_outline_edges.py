"""D5 edge rows: both plans (one pass / split) give the reference's nesting."""

from regimen.operators import nesting as D
from regimen.sources.seed import seed_model

EXTRA = {
    # day 8: two sessions; day 9: the same session in two slots; day 10: no slot at all
    "setup_days": [("day:8", 8, "routine:ppl"), ("day:9", 9, "routine:ppl"), ("day:10", 10, "routine:ppl")],
    "setup_sessions": [("ses:Core", "routine:ppl", "Core"), ("ses:Blank", "routine:ppl", "Blank")],
    "setup_days_sessions": [("ds:8a", "day:8", "ses:Core", 2), ("ds:8b", "day:8", "ses:Push", 1),
                            ("ds:9a", "day:9", "ses:Pull", 1), ("ds:9b", "day:9", "ses:Pull", 2)],
    "custom_exercises": [("ce:empty", "", 1)],
    "setup_session_exercises": [("sse:Core:1", "ses:Core", None, "ce:empty", 1, None),
                                ("sse:Core:2", "ses:Core", None, "ce:Squat", 2, None)],
}


def _nested(spark, strategy):
    spark.conf.set("spark.regimen.ordinal.strategy", strategy)
    try:
        flat = D.day_outline(seed_model(spark, EXTRA))
        rows = D.nest_day_outline(flat).orderBy("day_number").collect()
    finally:
        spark.conf.unset("spark.regimen.ordinal.strategy")
    return {r.day_number: [(s.name, list(s.exercises)) for s in r.sessions] for r in rows}


def test_day_session_lists_keep_null_for_days_without_session(spark):
    flat = D.day_session_list(seed_model(spark, EXTRA))
    got = {r.day_number: list(r.session_names) for r in D.nest_day_sessions(flat).collect()}
    assert got[1] == ["Push"] and got[8] == ["Push", "Core"] and got[9] == ["Pull", "Pull"]
    assert got[10] == [None]


def test_edge_days_in_both_plans(spark):
    for strategy in ("auto", "split"):
        got = _nested(spark, strategy)
        assert got[8] == [("Push", ["Push-ups", "Bench press"]), ("Core", ["Squat"])]
        assert got[9] == [("Pull", ["Single Arm Curls(L)", "Single Arm Curls(R)",
                                    "Single Arm Curls(L)", "Single Arm Curls(R)"])]
        assert got[10] == [(None, [])]
        assert got[2] == [("Rest1", [])]
