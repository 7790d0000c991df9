"""Driver tables -> the 16-table model.

One routine per customer; its days are the customer's orders (numbered by
order date, order key); each day has one session named after the order; the
session's exercises are the order's line items (numbered by line number,
part, supplier), each with one planned set. Orders are also logged workouts:
status F = completed at the order date, O and P = in progress.

Every table is a lazy DataFrame; a query pays only for the tables it touches, and Catalyst
prunes columns down to the scan. What costs a shuffle to derive (numbered orders, numbered line items, the
exercise catalogue with its owners) is written once per version of the source files, in buckets
of the order (``levels``): all levels of a workout or a session then join without an exchange.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators.ordinal import STRATEGY_CONF, in_one_window, ordinal
from regimen.sources.levels import Levels
from regimen.sources.tables import Model

#: the driver tables that the model and its requests are read from
SOURCES = ("customer", "part", "orders", "lineitem", "events")

# Fixed values of the adapter (mirrored by the DuckDB oracle).
ROUTINE_PREFIX = "Plan "
PASSWORD_PLACEHOLDER = "*"
BLOCKING_MODULUS = 11
NO_ROUTINE_MODULUS = 13     # customers whose cursor has no routine selected
DRAFT_MODULUS = 17          # routines still being created (drafts)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id(prefix: str = "l_") -> Column:
    """Natural key of a line item as text (not unique in every data set)."""
    return F.concat_ws("-", *[F.col(prefix + c).cast("string")
                              for c in ("orderkey", "linenumber", "partkey", "suppkey")])


#: what the two models read of a numbered line item; the other columns only order it
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus", "exercise_order", "line_id"]

# order of line items inside an order; every column takes part, so equal rows
# are the only ties and the numbering is deterministic
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


_SESSION_NAME = "concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING))"
_PLAN_NAME = f"concat('{ROUTINE_PREFIX}', CAST({{}} AS STRING))"
_COMPLETED = "o_orderstatus = 'F'"
_NO_TEXT, _NO_INT, _NO_KEY = "CAST(NULL AS STRING)", "CAST(NULL AS INT)", "CAST(NULL AS BIGINT)"
_WEIGHT = "CAST(l_quantity * 0.5D AS DECIMAL(6,2))"
_GOAL = "CAST(floor(l_quantity) AS INT)"
_DONE = "CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity * (1.0D - l_discount)) AS INT) END"
_SLOTS = dict(id="o_orderkey", day_id="o_orderkey", session_id="o_orderkey", session_order="1")

#: every table as columns over what it is derived from
DERIVED: dict[str, tuple[str, dict[str, str]]] = dict(
    users=("customer", dict(id="c_custkey", username="c_name", password=f"'{PASSWORD_PLACEHOLDER}'")),
    users_current_details=("cursors", dict(
        user_id="c_custkey", current_routine_id=f"CASE WHEN c_custkey % {NO_ROUTINE_MODULUS} != 0 THEN c_custkey END",
        current_day_number="CAST(c_custkey % n_days + 1 AS INT)", current_session_number="1")),
    exercises=("part", dict(id="p_partkey", name="p_name")),
    custom_exercises=("exercises", dict(id="id", name="name", user_id="user_id")),
    setup_routines=("customer", dict(
        id="c_custkey", name=_PLAN_NAME.format("c_custkey"), user_id="c_custkey", routine_created=f"c_custkey % {DRAFT_MODULUS} != 0",
        routine_edit_in_progress="false")),
    setup_days=("days", dict(id="o_orderkey", day_number="day_number", setup_routine_id="o_custkey")),
    setup_sessions=("days", dict(id="o_orderkey", setup_routine_id="o_custkey", name=_SESSION_NAME)),
    setup_days_sessions=("days", _SLOTS),
    setup_session_exercises=("lines", dict(
        id="line_id", setup_session_id="l_orderkey", exercise_id="l_partkey", custom_exercise_id="l_partkey", exercise_order="exercise_order",
        exercise_comment=_NO_TEXT)),
    setup_exercise_details=("lines", dict(
        id="line_id", setup_session_exercise_id="line_id", weight=_WEIGHT, cur_set="1", reps_goal=_GOAL, myo_order=_NO_INT)),
    track_routines=("days", dict(
        id="o_orderkey", name=_PLAN_NAME.format("o_custkey"), user_id="o_custkey",
        setup_id=f"CASE WHEN o_orderstatus = 'P' AND o_orderkey % {BLOCKING_MODULUS} = 0 THEN o_custkey END", in_progress=f"NOT ({_COMPLETED})",
        completion_date=f"CASE WHEN {_COMPLETED} THEN CAST(o_orderdate AS TIMESTAMP) END")),
    track_days=("days", dict(id="o_orderkey", day_number="day_number", track_routine_id="o_orderkey", setup_id=_NO_KEY)),
    track_sessions=("days", dict(id="o_orderkey", track_routine_id="o_orderkey", name=_SESSION_NAME, setup_id=_NO_KEY)),
    track_days_sessions=("days", _SLOTS),
    track_session_exercises=("lines", dict(
        id="line_id", track_session_id="l_orderkey", exercise_id="l_partkey", custom_exercise_id="l_partkey", exercise_order="exercise_order",
        exercise_comment=_NO_TEXT, setup_id=_NO_TEXT)),
    track_exercise_details=("lines", dict(
        id="line_id", track_session_exercise_id="line_id", weight=_WEIGHT, cur_set="1", reps_goal=_GOAL, reps_done=_DONE, myo_order=_NO_INT,
        setup_id=_NO_TEXT)))

#: a line item is an exercise with its one set
_BOTH = ("lines", dict(
    sse_id="line_id", session_id="l_orderkey", exercise_id="l_partkey", custom_exercise_id="l_partkey", exercise_order="exercise_order",
    exercise_comment=_NO_TEXT, set_id="line_id", weight=_WEIGHT, cur_set="1", reps_goal=_GOAL, reps_done=_DONE, myo_order=_NO_INT))


def from_driver(spark: SparkSession, sf_dir: str) -> Model:
    """The model over the driver tables as they are now, derived lazily: a query reads only
    those that its tables need."""
    numbered = Numbered(spark, sf_dir)

    def derived(spec: tuple[str, dict[str, str]]) -> Callable[[], DataFrame]:
        source, columns = spec
        return lambda: numbered.source(source).selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])

    return Model({name: derived(spec) for name, spec in DERIVED.items()}, dict(plan_sets=derived(_BOTH), log_sets=derived(_BOTH)))


class Numbered:
    """The derived levels of one version of the driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.read = functools.partial(driver_table, spark, sf_dir)

    def source(self, name: str) -> DataFrame:
        return getattr(self, name)() if name in ("days", "lines", "exercises", "cursors") else self.read(name)

    def cursors(self) -> DataFrame:
        """Customers with their number of orders."""
        n_days = self.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_days"))
        return self.read("customer").select("c_custkey").join(n_days, F.col("c_custkey") == F.col("o_custkey"), "left")

    @functools.cached_property
    def levels(self) -> Levels:
        tag = self.spark.conf.get(STRATEGY_CONF, "auto")        # the forced plans are kept apart, for tests
        return Levels(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "part")], "" if tag == "auto" else tag)

    def days(self) -> DataFrame:
        """Orders with the number of their day among those of the customer."""
        def build():
            columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"]
            return ordinal(self.read("orders").select(*columns), ["o_custkey"], ["o_orderdate", "o_orderkey"], "day_number")
        return self.levels.table("days", build, "o_orderkey", ["o_orderkey"])

    def lines(self) -> DataFrame:
        """Line items with their place in the order."""
        def build():
            rows = self.read("lineitem").select("l_orderkey", *LINE_ORDER)
            if plain := in_one_window(rows, ["l_orderkey"]):
                rows = self.levels.deal(rows, "l_orderkey")                   # the window's exchange is the one of the buckets
            placed = ordinal(rows, ["l_orderkey"], LINE_ORDER, "exercise_order", bounded=plain)
            placed = placed if plain else self.levels.deal(placed, "l_orderkey")
            placed = placed.withColumn("line_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("exercise_order").cast("string")))
            return placed.select(*LINE_COLUMNS)
        return self.levels.table("lines", build, "l_orderkey", ["l_orderkey", "exercise_order"], dealt=True)

    def exercises(self) -> DataFrame:
        """Parts, each owned by the customer of the first order that used it."""
        def build():
            owner = (self.read("lineitem").select("l_orderkey", "l_partkey")
                     .join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
                     .groupBy("l_partkey").agg(F.min_by("o_custkey", "o_orderkey").alias("user_id")))
            return (self.read("part").join(owner, F.col("p_partkey") == F.col("l_partkey"), "left")
                    .select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "user_id"))
        return self.levels.table("exercises", build, "id", ["id"])
