"""What steps whose result is stored leave on the disk."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from regimen.operators import quality as J
from regimen.operators import transform as I
from regimen.operators import upkeep as K
from regimen.plans.catalog import QUERIES
from regimen.sources import levels
from regimen.sources.dense import from_driver_dense
from regimen.sources.levels import packed, shuffles_removed, stored
from regimen.sources.tables import TableStore

from conftest import SMALL


def shuffle_files(spark) -> set[str]:
    """The data files of shuffles that this session holds."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {n for d in folders for _, _, names in os.walk(str(d)) for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def left(spark, before: set[str]) -> set[str]:
    """Files that came since ``before``; they are removed by other threads."""
    for _ in range(100):
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_a_snapshot_leaves_no_shuffle_files(spark):
    m = from_driver_dense(spark, SMALL)
    req = (m.setup_routines.filter("name IS NOT NULL").select(F.col("id").alias("request_id"), "user_id", F.col("name").alias("routine_name")))
    before = shuffle_files(spark)
    new = I.snapshot(m, req, "disk", whole_routine=True)
    assert not left(spark, before)
    assert all(df.count() for df in new.values())


def test_frames_are_stored_one_after_another_and_packed(spark):
    ids = spark.range(4000).select(F.concat_ws("-", (F.col("id") / 4).cast("long"), F.col("id") % 4).alias("id"), (F.col("id") % 7).alias("n"))
    parts = [ids.groupBy("id").agg(F.max("n").alias("n")).filter(f"n % 2 = {k}") for k in (0, 1)]
    before = shuffle_files(spark)
    rows = stored(parts, "test-parts")
    assert not left(spark, before)
    assert rows.columns == ["id", "n"] and sorted(rows.collect()) == sorted(ids.collect())
    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    plain = f"{os.path.dirname(rows.inputFiles()[0])}-plain"
    ids.coalesce(1).write.parquet(plain)
    ids.coalesce(1).write.options(**packed(["id", "n"])).parquet(f"{plain}-packed")

    def size(path):
        path = path.removeprefix("file:").replace("///", "/")
        return sum(os.path.getsize(f"{path}/{n}") for n in os.listdir(path) if n.endswith(".parquet"))
    assert size(f"{plain}-packed") * 2 < size(plain)


def test_the_setting_is_given_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(key, None)
    with shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == given


def test_a_report_from_changes_leaves_no_shuffle_files_and_reads_stored_parts(spark):
    before = shuffle_files(spark)
    report = QUERIES["j_report_from_changes"](spark, SMALL)
    assert not left(spark, before)
    assert report.inputFiles() and all("/regimen-stored/" in f for f in report.inputFiles())


def test_reports_from_changes_in_slices_equal_full_reports(spark, monkeypatch):
    store = TableStore(spark, tempfile.mkdtemp(prefix="regimen-store-", dir="/tmp"))
    store.commit(from_driver_dense(spark, SMALL).tables)
    old = store.load()
    sessions, exercises = old.setup_sessions, old.track_session_exercises
    store.commit({"setup_sessions": sessions.filter("id % 5 <> 0").unionByName(sessions.filter("id % 17 = 0")),
                  "track_session_exercises": exercises.filter("exercise_order <> 2 OR track_session_id % 3 <> 0")
                  .withColumn("exercise_order", F.expr("IF(track_session_id % 7 = 0, 1, exercise_order)"))})
    new, changed = store.load(), K.changed_tables(store, 1, 2)
    monkeypatch.setattr(levels, "SLICE_BYTES", 1)
    assert levels.slices(old.setup_sessions, new.setup_sessions) == levels.MOST_SLICES > 1
    report = K.apply_delta(J.model_violations(old, apart=True), K.report_delta(old, new, changed, apart=True))
    rows, want = (sorted(map(str, df.select(*J.REPORT_COLUMNS).collect())) for df in (report, J.model_violations(new)))
    assert rows == want and {"unique", "primary_key", "foreign_key"} <= {r.rule for r in report.select("rule").distinct().collect()}


def test_rows_are_compared_on_the_columns_of_rules(spark):
    columns = ["id", "track_session_exercise_id", "weight", "cur_set", "reps_goal", "reps_done", "myo_order", "setup_id"]
    assert K._read_columns("track_exercise_details", columns) == ["id", "track_session_exercise_id", "cur_set", "reps_goal", "reps_done", "myo_order"]
    m = from_driver_dense(spark, SMALL)
    lighter = m.replace(track_exercise_details=m.track_exercise_details.withColumn("weight", F.lit(1).cast("decimal(6,2)")))
    assert K.report_delta(m, lighter, ["track_exercise_details"]).count() == 0
