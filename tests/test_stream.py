"""K1: replayed and reordered micro-batches give the same end state as I8."""

import tempfile

import pytest
from pyspark.sql import functions as F

from regimen.operators import transform as I
from regimen.plans import requests as R
from regimen.plans.q_stream import streamed_events
from regimen.sources import claims
from regimen.sources.adapter import from_driver
from regimen.streaming import setlog as K

from conftest import SMALL


def _state(df):
    return sorted((r.id, r.weight, r.reps_done) for r in df.select("id", "weight", "reps_done").collect())


def test_stream_equals_batch_under_replay_and_reordering(spark):
    m = from_driver(spark, SMALL)
    ok, _ = R.validated_set_log(R.set_log_events(spark, SMALL, m))
    want = _state(I.update_logged_sets(m, ok))

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="regimen-events-", dir="/tmp")
    # three files written newest first, so later events arrive in earlier batches
    for i, part in enumerate([2, 1, 0]):
        events.filter(F.col("event_id") % 3 == part).write.parquet(f"{folder}/part{i}")
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder, 1))
    assert _state(K.apply_state(m, K.current_state(spark, root))) == want

    # a restart over the same checkpoint processes nothing new and keeps the state
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder, 1), root)
    assert _state(K.apply_state(m, K.current_state(spark, root))) == want

    # the same events replayed under another name are de-duplicated per batch
    # and can only rewrite identical values
    events.write.parquet(f"{folder}/part9")
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)
    assert _state(K.apply_state(m, K.current_state(spark, root))) == want


def test_outcomes_add_up_and_an_empty_stream_has_an_empty_state(spark):
    m = from_driver(spark, SMALL)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="regimen-events-", dir="/tmp")
    events.filter("false").write.parquet(f"{folder}/part0")
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder))
    assert K.current_state(spark, root).count() == 0 and K.set_log(spark, root).filter("outcome = 'update'").count() == 0
    events.write.parquet(f"{folder}/part1")
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)
    counts = {r["outcome"]: r["count"] for r in K.set_log(spark, root).groupBy("outcome").count().collect()}
    ok, bad = R.validated_set_log(R.set_log_events(spark, SMALL, m))
    assert counts["refused"] == bad.count() and counts["update"] + counts["unresolved"] == ok.count() and counts["unresolved"] > 0


def _parts(spark, *conditions):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="regimen-events-", dir="/tmp")
    for i, c in enumerate(conditions):
        events.filter(c).write.parquet(f"{folder}/part{i}")
    return folder


def _want(spark, m):
    ok, _ = R.validated_set_log(R.set_log_events(spark, SMALL, m))
    return _state(I.update_logged_sets(m, ok))


def test_logs_that_precede_their_workout_arrive(spark):
    m = from_driver(spark, SMALL)
    none = m.replace(track_routines=m.track_routines.filter("false"))
    half = m.replace(track_routines=m.track_routines.filter("id % 2 = 0"))
    folder = _parts(spark, "event_id % 2 = 0", "event_id % 2 = 1")
    root = K.run_set_log_stream(none, streamed_events(spark, m, f"{folder}/part0", folder))
    assert K.current_state(spark, root).count() == 0 and K.set_log(spark, root).filter("outcome = 'update'").count() == 0
    K.run_set_log_stream(half, streamed_events(spark, m, f"{folder}/part*", folder), root)
    some = K.current_state(spark, root).count()
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)
    assert 0 < some < K.current_state(spark, root).count()
    assert _state(K.apply_state(m, K.current_state(spark, root))) == _want(spark, m)
    # every log is told once, with the outcome that it would have had with the workouts open from the start
    straight = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder))
    told = lambda r: sorted((x.event_id, x.outcome, x.set_id) for x in K.set_log(spark, r).select("event_id", "outcome", "set_id").collect())
    key = lambda rows: [tuple(map(str, x)) for x in rows]
    assert key(told(root)) == key(told(straight))


def test_a_killed_fold_is_done_again(spark, monkeypatch):
    m = from_driver(spark, SMALL)
    folder = _parts(spark, "event_id % 2 = 0", "event_id % 2 = 1")
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part0", folder))
    before, entry = _state(K.apply_state(m, K.current_state(spark, root))), K.manifest(spark, root)
    real = claims.publish

    def dies(spark, path, text):
        if "/state/_manifest/" in path:
            raise RuntimeError("killed")
        return real(spark, path, text)

    monkeypatch.setattr(claims, "publish", dies)
    with pytest.raises(RuntimeError):
        K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)
    assert K.manifest(spark, root) == entry and _state(K.apply_state(m, K.current_state(spark, root))) == before
    monkeypatch.setattr(claims, "publish", real)
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)       # no new events, but unfolded epochs
    assert _state(K.apply_state(m, K.current_state(spark, root))) == _want(spark, m)
    # what the killed run left behind is gone, as is what two manifests ago named
    kept = {p for e in (K.manifest(spark, root), K.manifest(spark, root, 1)) for p in e["folders"].values()}
    there = {f"{root}/state/data/{r}/{b}" for r in claims.listed(spark, f"{root}/state/data") for b in claims.listed(spark, f"{root}/state/data/{r}") if b.startswith("bucket=")}
    assert there == kept


def test_a_run_writes_only_the_buckets_it_touched(spark):
    m = from_driver(spark, SMALL)
    folder = _parts(spark, "event_id % 10 > 0", "event_id % 400 = 0")
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part0", folder), buckets=32)
    first = K.manifest(spark, root)
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part*", folder), root)
    second = K.manifest(spark, root)
    assert 0 < len(second["wrote"]) < len(first["wrote"]) <= 32 and second["buckets"] == 32
    assert {b: p for b, p in second["folders"].items() if int(b) not in second["wrote"]} == {b: p for b, p in first["folders"].items() if int(b) not in second["wrote"]}
    assert all(first["folders"].get(str(b)) != second["folders"][str(b)] for b in second["wrote"])


def test_half_an_epoch_is_not_read(spark):
    m = from_driver(spark, SMALL)
    folder = _parts(spark, "event_id % 2 = 0")
    root = K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part0", folder))
    n, entry = K.set_log(spark, root).count(), K.manifest(spark, root)
    spark.read.parquet(f"{root}/log/epoch=0").write.partitionBy("outcome").parquet(f"{root}/log/epoch=7")       # killed before its marker
    assert K.set_log(spark, root).count() == n
    K.run_set_log_stream(m, streamed_events(spark, m, f"{folder}/part0", folder), root)
    assert K.manifest(spark, root) == entry                     # nothing new: nothing written
