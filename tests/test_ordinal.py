"""Invariants of the skew-safe building blocks against plain computations."""

import random
import tempfile

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from regimen.operators import transform as I
from regimen.operators.nesting import runs
from regimen.operators.ordinal import count_before, groups_bounded, ordinal, split_runs
from regimen.plans import catalog


def _skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    # one key holds about a third of the rows
    rows = [(0 if rnd.random() < 0.34 else rnd.randrange(1, 40), i, rnd.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, i int, v int").repartition(7)


def test_ordinal_matches_row_number_on_hot_key(spark):
    df = _skewed(spark)
    got = ordinal(df, ["k"], ["v", "i"], "o", partitions=16, bounded=False)
    want = df.withColumn("o2", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    j = got.join(want, ["k", "i", "v"], "full")
    assert j.count() == df.count()
    assert j.filter("o IS NULL OR o2 IS NULL OR o <> o2").count() == 0


def test_ordinal_descending_order(spark):
    df = _skewed(spark, 500, 2)
    got = ordinal(df, ["k"], [F.col("v").desc(), "i"], "o", partitions=5, bounded=False)
    want = df.withColumn("o2", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "i")))
    assert got.join(want, ["k", "i", "v"]).filter("o <> o2").count() == 0


def test_count_before_matches_brute_force(spark):
    rnd = random.Random(3)
    left = [(rnd.randrange(3), i, rnd.randrange(20)) for i in range(200)]
    right = [(rnd.randrange(3), rnd.randrange(20)) for _ in range(300)]
    L = spark.createDataFrame(left, "k int, id int, v int")
    R = spark.createDataFrame(right, "k int, v int")
    for inclusive in (False, True):
        for bounded in (False, True):
            got = {r.id: r.n for r in count_before(L, R, ["k"], "v", "id", "n", inclusive,
                                                   bounded=bounded).collect()}
            for k, i, v in left:
                want = sum(1 for rk, rv in right if rk == k and (rv <= v if inclusive else rv < v))
                assert got[i] == want, (inclusive, bounded)


def test_runs_match_adjacent_grouping(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(5):
        for pos in range(60):
            rows.append((g, pos, rnd.choice("ab"), rnd.randrange(2)))
    df = spark.createDataFrame(rows, "g int, pos int, name string, ord int")
    got = {(r.g, r.pos): (r.run_pos, r.item_pos) for r in runs(df, ["g"], ["name", "ord"], ["pos"]).collect()}
    for g in range(5):
        seq = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        run, item, prev = 0, 0, None
        for _, pos, name, o in seq:
            if (name, o) != prev:
                run, item, prev = run + 1, 0, (name, o)
            item += 1
            assert got[(g, pos)] == (run, item)


def _grouped(rows):
    """(run, item) by (group, pos), row after row."""
    out, last = {}, {}
    for g, pos, name, o in sorted(rows, key=lambda r: r[1]):
        run, item, prev = last.get(g, (0, 0, ()))
        run, item = (run, item + 1) if prev == (name, o) else (run + 1, 1)
        last[g] = (run, item, (name, o))
        out[g, pos] = (run, item)
    return out


@pytest.mark.parametrize("seed,stay", [(1, 0.0), (2, 0.9), (3, 0.995), (4, 1.0)])
def test_runs_across_ranges(spark, seed, stay):
    """Runs that end at, begin at and cover whole ranges: a third of the rows in one group, short to endless runs."""
    rnd = random.Random(seed)
    rows, value = [], ("a", None)
    for pos in range(600):
        if rnd.random() >= stay:
            value = (rnd.choice(["a", "b", None]), rnd.choice([1, None]))
        rows.append((rnd.choice([0, 0, None, 1, 2, rnd.randrange(3, 30)]), pos, *value))
    df = spark.createDataFrame(rows, "g int, pos int, name string, ord int").repartition(5)
    got = split_runs(df, ["g"], ["name", "ord"], ["pos"], "run_pos", "item_pos", partitions=23)
    assert got.columns == [*df.columns, "run_pos", "item_pos"]
    assert {(r.g, r.pos): (r.run_pos, r.item_pos) for r in got.collect()} == _grouped(rows)
    assert split_runs(df.filter("false"), ["g"], ["name"], ["pos"], "run_pos", "item_pos").collect() == []


def test_split_runs_store_the_rows_once(spark, monkeypatch):
    calls = []
    whole = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a, **k: calls.append(1) or whole(self, *a, **k))
    df = spark.createDataFrame([(1, k, k // 3) for k in range(50)], "g int, pos int, v int")
    got = runs(df, ["g"], ["v"], ["pos"], bounded=False)
    assert got.filter("run_pos <> v + 1 OR item_pos <> pos % 3 + 1").count() == 0 and len(calls) == 1


def test_hot_group_is_detected(spark):
    df = _skewed(spark)
    assert groups_bounded(df, ["k"])                 # default floor: 1M rows per group
    assert not groups_bounded(df, ["k"], limit=500)  # the third of 3000 rows is hot
    spark.conf.set("spark.regimen.ordinal.hotRows", "10")
    try:
        got = runs(df.withColumn("name", F.lit("a")), ["k"], ["name"], ["v", "i"])
        assert got.filter("run_pos <> 1").count() == 0
        assert got.groupBy("k").agg(F.max("item_pos").alias("m"), F.count("*").alias("n")) \
            .filter("m <> n").count() == 0
    finally:
        spark.conf.unset("spark.regimen.ordinal.hotRows")


def _rows(df):
    return sorted(map(str, df.collect()))


def _both_plans(spark, build):
    """The rows of ``build()`` under the plain windows and under the split plan."""
    out = []
    for strategy in ("window", "split"):
        spark.conf.set("spark.regimen.ordinal.strategy", strategy)
        try:
            out.append(_rows(build()))
        finally:
            spark.conf.unset("spark.regimen.ordinal.strategy")
    return out


def test_both_plans_agree_on_nulls_and_ties(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, 1, None]), i, rnd.choice(["a", None, "b"]), rnd.choice([1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, pos int, name string, ord int").repartition(5)
    window, split = _both_plans(spark, lambda: runs(df, ["g"], ["name", "ord"], ["pos"]))
    assert window == split and len(window) == 300
    window, split = _both_plans(spark, lambda: ordinal(df, ["g"], ["name", "pos"], "o"))
    assert window == split
    right = df.select("g", F.col("ord").alias("v"))
    left = df.select("g", F.col("pos").alias("id"), F.col("ord").alias("v"), "name")
    window, split = _both_plans(spark, lambda: count_before(left, right, ["g"], "v", "id", "n", inclusive=True))
    assert window == split and len(window) == 300


def test_delete_and_shift_keeps_rows_without_a_parent(spark):
    rows = [(f"{p}-{o}-{k}", p, o) for p in (1, 2, None) for o in (1, 2, 3, None) for k in (0, 1)]
    kids = spark.createDataFrame(rows, "id string, p int, o int")
    cuts = spark.createDataFrame([(1, 1), (1, 1), (2, 3), (2, 9), (None, 1), (1, None)], "p int, o int")

    def build():
        kept, gone = I.delete_and_shift(kids, "p", "o", cuts)
        return kept.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))

    window, split = _both_plans(spark, build)
    assert window == split and len(window) == len(rows)
    spark.conf.set("spark.regimen.ordinal.strategy", "window")
    try:
        got = {r.id: (r.o, r.gone) for r in build().collect()}
    finally:
        spark.conf.unset("spark.regimen.ordinal.strategy")
    assert got["1-1-0"] == (1, True) and got["1-2-1"] == (1, False) and got["1-3-0"] == (2, False) and got["2-3-1"] == (3, True)
    assert got["None-1-0"] == (1, False) and got["1-None-0"] == (None, False) and got["2-2-0"] == (2, False)


HOT = ["d4_day_session_list_dense", "d5_day_outline_dense", "d6_open_session_exercises_dense", "d8_plan_sets_by_order_dense", "f2_slot_row_pages_dense",
       "f3_day_pages", "f4_record_pages", "f7_sorted_sessions", "i4_append_exercises", "i5_delete_days", "i6_reorder_exercises", "i16_next_training_day",
       "b11_routine_name_like"]


@pytest.fixture(scope="module")
def hot_owner(spark):
    """The driver tables with a third of all orders under one customer."""
    folder = tempfile.mkdtemp(prefix="regimen-hot-", dir="/tmp")
    for t in ("customer", "part", "lineitem", "events"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").filter("o_orderkey % 3 = 0")
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit(1).cast("long")).otherwise(F.col("o_custkey")))
    orders.write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", HOT)
def test_both_plans_agree_on_a_hot_owner(spark, hot_owner, name):
    window, split = _both_plans(spark, lambda: catalog.QUERIES[name](spark, hot_owner))
    assert window == split and window
