"""Steps whose work grows with the tables: what is written, read and shuffled of them."""

import re
import tempfile

from pyspark.sql import functions as F

from regimen.operators import transform as I
from regimen.plans.catalog import QUERIES
from regimen.plans.q_stream import streamed_events
from regimen.session import checkpoint_dir
from regimen.sources import adapter, claims
from regimen.sources.adapter import from_driver
from regimen.sources.dense import from_driver_dense
from regimen.streaming import setlog as K

from conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_stored_with_the_columns_of_the_models_alone(spark):
    assert adapter.Numbered(spark, SMALL).lines().columns == adapter.LINE_COLUMNS


def test_a_snapshot_table_reads_its_own_rows_alone(spark):
    m = from_driver_dense(spark, SMALL)
    req = (m.setup_routines.filter("name IS NOT NULL AND id % 7 = 0")
           .select(F.col("id").alias("request_id"), "user_id", F.col("name").alias("routine_name")))
    new = I.snapshot(m, req, "t", whole_routine=True)
    for df in new.values():
        scan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*table#", scan) and "ExistingRDD" not in scan
    assert all(df.count() for df in new.values())


def test_only_rows_with_lineage_meet_the_users(spark):
    m = from_driver_dense(spark, SMALL)
    users = m.users.filter("id % 3 = 0").select(F.col("id").alias("user_id"))
    new = I.clear_lineage(m, users)
    of_users = m.track_routines.filter("user_id % 3 = 0 AND setup_id IS NOT NULL").select(F.col("id").alias("track_routine_id"))
    hit = {r.track_routine_id for r in of_users.collect()}
    for table, parent in (("track_routines", "id"), ("track_days", "track_routine_id"), ("track_sessions", "track_routine_id")):
        old = {r["id"]: r for r in m[table].collect()}
        rows = new[table].collect()
        assert len(rows) == len(old) and new[table].columns == m[table].columns
        assert {r["id"]: r.setup_id for r in rows} == {k: None if r[parent] in hit else r.setup_id for k, r in old.items()}
        assert any(r.setup_id is not None for r in rows) and any(old[r["id"]].setup_id is not None and r.setup_id is None for r in rows)
        joined = new[table]._jdf.queryExecution().optimizedPlan().children().apply(0)
        assert "Union" in _plan(new[table]) and not any("Join" in line for line in joined.toString().splitlines())


def test_the_next_workouts_of_a_start_are_found_once(spark):
    """E2's result asks for them twice; their windows are no part of its plan."""
    plan = _plan(QUERIES["e2_start_workout"](spark, SMALL))
    assert "Window" not in plan


def test_the_stream_asks_for_the_sets_of_all_users_once_and_of_waiting_users_later(spark, monkeypatch):
    m = from_driver(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="regimen-events-", dir="/tmp")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in (0, 1):
        events.filter(F.col("event_id") % 2 == i).write.parquet(f"{folder}/part{i}")
    asked, real = [], K.open_set_index

    def index(model, users=None):
        asked.append(None if users is None else {r.user_id for r in users.collect()})
        return real(model, users)

    def kept():
        return [n for n in claims.listed(spark, f"{checkpoint_dir(spark)}/regimen-stored") if n.startswith("open-sets")]

    monkeypatch.setattr(K, "open_set_index", index)
    before = len(kept())
    few = m.replace(track_routines=m.track_routines.filter("id % 3 > 0"))
    root = K.run_set_log_stream(few, streamed_events(spark, m, f"{folder}/part*", folder, 1))
    assert asked == [None]                                                        # for both batches; no log of this run is judged again
    assert len(kept()) == before + 1                                              # the second batch reads them stored
    waiting = {r.user_id for r in spark.read.parquet(K.manifest(spark, root)["waiting"]).collect()}
    told = {r.event_id: r.set_id for r in K.set_log(spark, root).filter("outcome = 'unresolved'").collect()}
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder, 1), root)
    assert asked == [None, waiting]                                               # no batch, but the waiting logs
    straight = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder))
    want, have = ({r.event_id: (r.outcome, r.set_id) for r in K.set_log(spark, x).collect()} for x in (straight, root))
    assert have == want and any(have[e][0] == "update" for e in told)
    assert len(kept()) == before + 1                                              # a run of one batch stores none


def test_open_sets_of_users(spark):
    m = from_driver_dense(spark, SMALL)
    users = m.users.filter("id % 4 = 1").select(F.col("id").alias("user_id"))
    some, every = I.open_set_index(m, users), I.open_set_index(m)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(some.columns).filter("user_id % 4 = 1").collect())) != []
