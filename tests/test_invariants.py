"""Invariants on the driver-derived model (sf0.001): ordinals stay dense
after I4-I6, a whole-routine snapshot is isomorphic to its source, and
the cascade leaves no orphan."""

from pyspark.sql import functions as F

from regimen.operators import quality as J
from regimen.operators import transform as I
from regimen.plans import requests as R
from regimen.sources.adapter import from_driver

from conftest import SMALL


def _dense(df, parent, ordinal_col):
    """Parents whose ordinals are not exactly 1..n."""
    g = df.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(ordinal_col).alias("d"),
                               F.min(ordinal_col).alias("lo"), F.max(ordinal_col).alias("hi"))
    return g.filter("n <> d OR lo <> 1 OR hi <> n").count()


def test_ordinals_dense_after_transforms(spark):
    m = from_driver(spark, SMALL)
    assert _dense(m.setup_days, "setup_routine_id", "day_number") == 0
    days = I.delete_days(m, R.delete_day_requests(m))["setup_days"]
    assert _dense(days, "setup_routine_id", "day_number") == 0
    d = (m.setup_session_exercises.filter(F.col("exercise_order").isin(1, 3))
         .select(F.col("setup_session_id").alias("session_id"), "exercise_order"))
    ex = I.delete_session_exercises(m, d)["setup_session_exercises"]
    assert _dense(ex, "setup_session_id", "exercise_order") == 0
    out, _ = I.reorder(m.setup_session_exercises, "setup_session_id", "exercise_order", R.reorder_requests(m))
    assert _dense(out, "setup_session_id", "exercise_order") == 0
    new = I.add_session_exercises(m, R.append_exercise_requests(spark, SMALL), "t")
    both = m.setup_session_exercises.select("setup_session_id", "exercise_order").unionByName(
        new["setup_session_exercises"].select("setup_session_id", "exercise_order"))
    assert _dense(both, "setup_session_id", "exercise_order") == 0


def test_whole_routine_snapshot_is_isomorphic(spark):
    m = from_driver(spark, SMALL)
    req = m.setup_routines.select(F.col("id").alias("request_id"), "user_id", F.col("name").alias("routine_name"))
    new = I.snapshot(m, req, "t", whole_routine=True)
    pairs = [("track_routines", "setup_routines"), ("track_days", "setup_days"),
             ("track_sessions", "setup_sessions"), ("track_days_sessions", "setup_days_sessions"),
             ("track_session_exercises", "setup_session_exercises"),
             ("track_exercise_details", "setup_exercise_details")]
    for t, s in pairs:
        assert new[t].count() == m[s].count(), t
    # every copied child points at a copied parent
    assert new["track_days"].join(new["track_routines"].select(F.col("id").alias("track_routine_id")),
                                  "track_routine_id", "left_anti").count() == 0
    assert new["track_exercise_details"].join(
        new["track_session_exercises"].select(F.col("id").alias("track_session_exercise_id")),
        "track_session_exercise_id", "left_anti").count() == 0
    # the copy keeps the plan's ordinals
    src = m.setup_session_exercises.select(F.col("id").cast("string").alias("setup_id"),
                                           F.col("exercise_order").alias("src_order"))
    assert (new["track_session_exercises"].join(src, "setup_id")
            .filter(F.col("exercise_order") != F.col("src_order")).count()) == 0


def test_cascade_on_driver_model_leaves_no_orphans(spark):
    m = from_driver(spark, SMALL)
    gone = m.setup_routines.filter(F.col("id") % 3 == 0).select("id")
    # restrict (I14) then cascade (I13): blocked routines stay, nothing dangles
    new, blocked = I.delete_routines(m, gone)
    m2 = m.replace(**new)
    assert blocked.count() > 0
    assert J.all_dangling_references(m2).count() == 0
    m3 = m.replace(**I.delete_log_tree(m, m.track_routines.filter(F.col("id") % 4 == 0).select("id")))
    assert J.all_dangling_references(m3).count() == 0
