"""Derived levels: one table per source version, co-located joins, whole or absent."""

import os
import re
import shutil
import tempfile
from decimal import Decimal

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from regimen.operators import outline as C
from regimen.operators import transform as I
from regimen.plans import catalog
from regimen.plans import requests as R
from regimen.sources import claims, levels
from regimen.sources.adapter import Numbered, from_driver
from regimen.sources.dense import from_driver_dense


def _exchanges(df) -> int:
    return len(re.findall(r"Exchange (hash|range|Single|Round)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def plain_plans(spark):
    """Plans without adaptive changes and broadcasts, as large tables get them."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _folder():
    folder = tempfile.mkdtemp(prefix="regimen-levels-", dir="/tmp")
    for t in ("customer", "orders", "lineitem", "part", "events"):
        os.makedirs(f"{folder}/{t}.parquet")
        shutil.copy(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet/part-0.parquet")
    return folder


def test_a_level_is_written_once_per_source_version(spark):
    folder = _folder()
    first = Numbered(spark, folder)
    assert first.days().count() == spark.read.parquet(f"{folder}/orders.parquet").count()
    assert Numbered(spark, folder).days().inputFiles() == first.days().inputFiles()
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000).write.mode("append").parquet(f"{folder}/orders.parquet")
    again = Numbered(spark, folder).days()
    assert again.count() == 2 * orders.count() and set(again.inputFiles()) != set(first.days().inputFiles())
    top = again.groupBy("o_custkey").agg(F.max("day_number").alias("m"), F.count(F.lit(1)).alias("n"))
    assert top.filter("m <> n").count() == 0


def test_a_level_of_another_session_or_writer_is_used(spark, monkeypatch):
    folder = _folder()
    mine = Numbered(spark, folder).levels
    made = []

    def build():
        made.append(1)
        return spark.range(100).withColumn("v", F.col("id") * 2)

    kept = mine.table("x", build, "id", ["id"])
    monkeypatch.setattr(levels, "_REGISTERED", {})              # as a new session
    other = Numbered(spark, folder).levels.table("x", build, "id", ["id"])
    assert made == [1] and other.inputFiles() == kept.inputFiles() and sorted(other.collect()) == sorted(kept.collect())
    # a writer that comes second leaves no files
    before = claims.listed(spark, mine.root)
    mine._write(f"{mine.root}/x.json", "x", spark.range(3), "id", ["id"])
    assert claims.listed(spark, mine.root) == before


def test_levels_of_a_workout_join_in_place(spark, plain_plans):
    m = from_driver(spark, SMALL)
    assert _exchanges(C.completed_workouts(m)) == 0 and _exchanges(C.active_sessions(m)) == 0
    assert _exchanges(C.open_workout_sets(m)) <= 1
    req = C.completed_workouts(m).withColumnRenamed("routine_id", "request_id")
    assert _exchanges(C.workout_details(m, req)) <= 6
    ok = spark.createDataFrame([(1, "Plan 1", 1, "x", 1, 1, Decimal(5), 5, 1)], "user_id long, routine_name string, day_number int, session_name string, "
                               "exercise_order int, set_number int, weight decimal(6,2), reps_done int, seq int")
    assert _exchanges(I.update_logged_sets(m, ok)) <= 6
    assert _exchanges(catalog.QUERIES["i8_update_logged_sets"](spark, SMALL)) <= 12


def test_joined_levels_equal_the_join_and_go_with_their_tables(spark):
    for source in (from_driver, from_driver_dense):
        m = source(spark, SMALL)
        for name in ("plan_sets", "log_sets"):
            lv = C.setup_levels(m) if name == "plan_sets" else C.track_levels(m)
            joined = lv["exercises"].join(lv["sets"], "sse_id")
            got = C.exercise_sets_of(m, name)
            assert sorted(got.columns) == sorted(joined.columns)
            key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
            assert key(got) == key(joined)
    m = from_driver(spark, SMALL)
    assert m.joined("log_sets") is not None
    changed = m.replace(track_exercise_details=m.track_exercise_details.filter("false"))
    assert changed.joined("log_sets") is None and changed.joined("plan_sets") is not None
    assert C.open_workout_sets(changed).count() == 0 and R.customers(spark, SMALL).count() > 0


def test_partitions_follow_the_stored_bytes_of_the_sources(spark):
    """More source bytes, more shuffle partitions and buckets; a smaller source gets the user's own number again."""
    from regimen.sources import levels as L

    given, paths = spark.conf.get("spark.sql.shuffle.partitions"), [f"{SMALL}/{t}.parquet" for t in ("orders", "lineitem")]
    size = sum(os.path.getsize(p) for p in paths)
    spark.conf.set(L.PARTITION_BYTES_CONF, "4096")
    try:
        assert L.fit_partitions(spark, paths) == -(-size // 4096) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert L.Levels(spark, paths).buckets == -(-size // 4096)
        assert L.fit_partitions(spark, []) == int(given)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert L.fit_partitions(spark, [f"{SMALL}/no-such.parquet"]) == 3
    finally:
        spark.conf.unset(L.PARTITION_BYTES_CONF)
        spark.conf.set("spark.sql.shuffle.partitions", given)


def test_dealt_rows_are_written_without_another_exchange(spark, monkeypatch, tmp_path):
    """Numbering the line items and writing their buckets is one exchange of the rows."""
    from regimen.sources import adapter, levels as L

    monkeypatch.setattr(L, "checkpoint_dir", lambda _: str(tmp_path))
    seen, write = [], L.Levels._write

    def watched(self, marker, name, df, key, order):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((plan.count("REPARTITION_BY_NUM"), plan.count("ENSURE_REQUIREMENTS")))
        write(self, marker, name, df, key, order)

    monkeypatch.setattr(L.Levels, "_write", watched)
    lines = adapter.Numbered(spark, SMALL).lines()
    assert seen == [(1, 0)] and lines.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
