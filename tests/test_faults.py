"""Cases that once gave wrong rows: patterns, names in blanks, equal requests, table versions."""

import shutil
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from regimen.operators import lookup as B
from regimen.operators import transform as I
from regimen.sources import claims
from regimen.sources.adapter import from_driver
from regimen.sources.tables import TableStore, VersionConflict, complete, literal_table


def _routines(spark, names):
    rows = [(k, n, 1, True, False) for k, n in enumerate(names)]
    return complete(spark, {"setup_routines": literal_table(spark, "setup_routines", rows)})


def test_patterns_with_nulls_escapes_and_heads(spark):
    m = _routines(spark, ["a\\b", "Push Day", "100%", "under_score", "pull"])
    asked = [(1, None, False), (2, "a\\\\b", True), (3, "a\\b", False), (4, "push%", True), (5, "PUSH_DAY", True), (6, "%day", True), (7, "100\\%", True),
             (8, "100\\%%", True), (9, "under\\_score", True), (10, "p\\ull", True), (11, "pull\\", False), (12, "", False), (13, "%", True), (14, "p_ll", True),
             (15, "puxx%_", False), (16, "a\\\\%", True), (17, "_______________", False)]
    req = spark.createDataFrame([(i, 1, p) for i, p, _ in asked], "request_id long, user_id long, pattern string")
    got = {r["request_id"]: r["exists"] for r in B.routine_name_like(m, req).collect()}
    assert got == {i: e for i, _, e in asked}


def test_renames_are_trimmed_before_they_are_compared(spark):
    sessions = literal_table(spark, "setup_sessions", [(1, 1, "Push"), (2, 1, "Rest1"), (3, 1, "Legs")])
    m = complete(spark, {"setup_sessions": sessions})
    req = spark.createDataFrame([(10, 1, 2, "  Push "), (11, 1, 3, " Arms  "), (12, 1, 3, " Back ")], "request_id long, seq int, session_id long, new_name string")
    new, bad = I.rename_sessions(m, req)
    assert {r["id"]: r["name"] for r in new.collect()} == {"1": "Push", "2": "Rest1", "3": "Back"}      # equal seq: the larger request id
    assert [(r["request_id"], r["reason"]) for r in bad.collect()] == [(10, "name already used")]


def test_two_equal_requests_leave_one_slot(spark):
    m = complete(spark, {"setup_routines": literal_table(spark, "setup_routines", [(1, "P", 1, True, False)]),
                         "setup_days": literal_table(spark, "setup_days", [(5, 1, 1)]),
                         "setup_sessions": literal_table(spark, "setup_sessions", [(1, 1, "A"), (2, 1, "B"), (3, 1, "C")]),
                         "setup_days_sessions": literal_table(spark, "setup_days_sessions", [(9, 5, 1, 1)])})
    req = spark.createDataFrame([(1, 1, 1, 1, 1, "B"), (2, 1, 1, 1, 1, "C")], "request_id long, seq int, routine_id long, day_number int, slot int, session_name string")
    slots, bad = I.assign_sessions(m, req, "r")
    assert [(r["day_id"], r["session_id"], r["session_order"]) for r in slots.collect()] == [("5", "3", 1)] and bad.count() == 0


def _folder():
    return tempfile.mkdtemp(prefix="regimen-store-", dir="/tmp")


def test_store_versions_are_atomic_and_exclusive(spark):
    root = _folder()
    store = TableStore(spark, root)
    days = literal_table(spark, "setup_days", [(1, 1, 1)])
    assert store.current() == (0, {})
    assert store.commit({"setup_days": days, "setup_sessions": literal_table(spark, "setup_sessions", [(1, 1, "A")])}) == 1
    other = TableStore(spark, root)
    stale = other.current()
    assert store.commit({"setup_days": days.union(days)}) == 2
    other.current = lambda: stale                             # a writer that read before the other one's commit
    with pytest.raises(VersionConflict):
        other.commit({"setup_days": days.filter("false")})
    assert TableStore(spark, root).load().setup_days.count() == 2 and TableStore(spark, root).load().setup_sessions.count() == 1


def _days(spark, n):
    return {"setup_days": literal_table(spark, "setup_days", [(k, k, 1) for k in range(1, n + 1)])}


def test_of_two_writers_at_one_version_one_succeeds(spark, monkeypatch):
    """B commits whole between A's check of the version and A's claim of it."""
    root = _folder()
    a, b = TableStore(spark, root), TableStore(spark, root)
    real, made = claims.publish, []

    def publish(spark, path, text):
        if not made:
            made.append(0)
            made[0] = b.commit(_days(spark, 2))
        return real(spark, path, text)

    monkeypatch.setattr(claims, "publish", publish)
    with pytest.raises(VersionConflict):
        a.commit(_days(spark, 1))
    assert made == [1] and a.versions() == [1] and a.load().setup_days.count() == 2
    assert len(claims.listed(spark, f"{root}/setup_days")) == 1                       # the loser's files are gone


def test_updates_of_many_writers_all_count(spark):
    root = _folder()
    TableStore(spark, root).commit(_days(spark, 1))

    def more(m):
        n = m.setup_days.agg(F.max("day_number")).first()[0]
        return {"setup_days": m.setup_days.unionByName(literal_table(spark, "setup_days", [(n + 1, n + 1, 1)]))}

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda _: TableStore(spark, root).update(more), range(4)))
    assert sorted(versions) == [2, 3, 4, 5]
    assert sorted(r["id"] for r in TableStore(spark, root).load().setup_days.collect()) == ["1", "2", "3", "4", "5"]
    assert TableStore(spark, root).load(2).setup_days.count() == 2


def test_a_claim_is_exclusive_on_other_file_systems_too(spark, monkeypatch):
    """The branch for Hadoop file systems, run on the local one."""
    monkeypatch.setattr(claims, "_is_local", lambda *_: False)
    folder = _folder()
    assert claims.publish(spark, f"{folder}/x/1.json", "é") and not claims.publish(spark, f"{folder}/x/1.json", "b")
    assert claims.content(spark, f"{folder}/x/1.json") == "é" and claims.listed(spark, f"{folder}/x") == ["1.json"]
    assert claims.listed(spark, f"{folder}/none") == []


def test_an_unreadable_manifest_is_not_an_empty_store(spark):
    root = _folder()
    TableStore(spark, root).commit({"setup_days": literal_table(spark, "setup_days", [(1, 1, 1)])})
    broken = TableStore(spark, "nosuchscheme://store/x")
    with pytest.raises(Exception):
        broken.current()


def test_the_model_follows_its_source(spark):
    folder = _folder()
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    for t in ("orders", "lineitem", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    customer.write.parquet(f"{folder}/customer.parquet")
    before = from_driver(spark, folder).users.count()
    customer.withColumn("c_custkey", F.col("c_custkey") + 10_000).write.mode("append").parquet(f"{folder}/customer.parquet")
    assert from_driver(spark, folder).users.count() == 2 * before
