"""Driver tables -> a denser model than ``adapter``: what the plain one has no case of.

* a day holds two consecutive orders of a customer, as slots 1 and 2; some days have the first session
  again in slot 3; customers divisible by 5 end with a rest day;
* every third order is named by its priority alone, so sessions of one day and open workouts of
  one user share names;
* lines of more than 25 units have two sets; every second line of a workout has a comment;
* some customers have one or two extra drafts without days or sessions;
* workouts of even orders keep their lineage on all levels;
* fixed residues break rules: NULL session names, slots 0, slots of missing sessions, goals of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.sources.adapter import Numbered, from_driver
from regimen.sources.tables import Model

# Fixed values of the fixture (mirrored by the DuckDB oracle).
REST_MODULUS, AGAIN_MODULUS, AGAIN_RESIDUE, SAME_NAME_MODULUS = 5, 10, 3, 3
NO_NAME_MODULUS, SLOT_ZERO_MODULUS, MISSING_MODULUS, ZERO_GOAL = 97, 83, 89, 13
DRAFT_MODULUS, TWO_DRAFTS_MODULUS, DRAFT_OFFSET = 19, 38, 1_000_000_000
TWO_SETS_FROM = 25


def from_driver_dense(spark: SparkSession, sf_dir: str) -> Model:
    """The denser model, derived lazily."""
    base = from_driver(spark, sf_dir)
    numbered = Numbered(spark, sf_dir)
    lines = numbered.lines
    key = F.col("o_orderkey")

    def pair() -> DataFrame:
        ranked = numbered.days().withColumnRenamed("day_number", "rk").withColumn("day_no", F.floor((F.col("rk") + 1) / 2).cast("int"))
        heads = ranked.filter("rk % 2 = 1").select("o_custkey", "day_no", key.alias("day_id"))
        named = (F.when(key % NO_NAME_MODULUS == 0, F.lit(None).cast("string")).when(key % SAME_NAME_MODULUS == 0, F.col("o_orderpriority"))
                 .otherwise(F.concat_ws(" ", "o_orderpriority", key.cast("string"))))
        return ranked.join(heads, ["o_custkey", "day_no"]).withColumn("title", named)

    def paired() -> DataFrame:
        return numbered.levels.table("paired", pair, "o_orderkey", ["o_orderkey"])

    def setup_days() -> DataFrame:
        p = paired().filter("rk % 2 = 1")
        rest = (p.filter(F.col("o_custkey") % REST_MODULUS == 0).groupBy("o_custkey").agg(F.max("day_no").alias("last"))
                .select((-F.col("o_custkey") - 1).alias("id"), (F.col("last") + 1).cast("int").alias("day_number"), F.col("o_custkey").alias("setup_routine_id")))
        return p.select(F.col("day_id").alias("id"), F.col("day_no").alias("day_number"), F.col("o_custkey").alias("setup_routine_id")).unionByName(rest)

    def setup_days_sessions() -> DataFrame:
        p = paired()
        order = F.when(key % SLOT_ZERO_MODULUS == 0, 0).otherwise(2 - F.col("rk") % 2).cast("int")
        slots = p.select(key.alias("id"), "day_id", key.alias("session_id"), order.alias("session_order"))
        again = (p.filter((key % AGAIN_MODULUS == AGAIN_RESIDUE) & (F.col("rk") % 2 == 1))
                 .select((-key).alias("id"), "day_id", key.alias("session_id"), F.lit(3).alias("session_order")))
        missing = p.filter(key % MISSING_MODULUS == 0).select((key + DRAFT_OFFSET).alias("id"), "day_id", F.lit(-1).cast("long").alias("session_id"),
                                                              F.lit(4).alias("session_order"))
        return slots.unionByName(again).unionByName(missing)

    def drafts() -> DataFrame:
        c = base.users.select(F.col("id").alias("user_id"))
        copies = F.when(F.col("user_id") % TWO_DRAFTS_MODULUS == 0, 2).when(F.col("user_id") % DRAFT_MODULUS == 0, 1).otherwise(0)
        return (c.withColumn("n", copies).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
                .select((F.col("user_id") + F.col("k") * DRAFT_OFFSET).alias("id"), F.lit(None).cast("string").alias("name"), "user_id",
                        F.lit(False).alias("routine_created"), F.lit(False).alias("routine_edit_in_progress")))

    def sets() -> DataFrame:
        n = F.when(F.col("l_quantity") > TWO_SETS_FROM, 2).otherwise(1)
        return lines().withColumn("cur_set", F.explode(F.sequence(F.lit(1), n))).withColumn(
            "set_id", F.concat_ws(".", "line_id", F.col("cur_set").cast("string")))

    goal = F.when(F.floor("l_quantity") == ZERO_GOAL, 0).otherwise(F.floor("l_quantity")).cast("int")
    weight = (F.col("l_quantity") * F.lit(0.5)).cast("decimal(6,2)")
    even = F.col("l_orderkey") % 2 == 0
    comment = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("note "), F.col("l_linenumber").cast("string")))
    reps_done = F.when((F.col("l_linestatus") == "F") & (F.col("cur_set") == 1),
                       F.floor(F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount"))).cast("int"))

    def kept(value, on=key % 2 == 0, kind="long"):
        return F.when(on, value).cast(kind)

    return base.replace(
        setup_routines=lambda: base.setup_routines.unionByName(drafts()),
        setup_days=setup_days,
        setup_sessions=lambda: paired().select(key.alias("id"), F.col("o_custkey").alias("setup_routine_id"), F.col("title").alias("name")),
        setup_days_sessions=setup_days_sessions,
        setup_session_exercises=lambda: lines().select(
            F.col("line_id").alias("id"), F.col("l_orderkey").alias("setup_session_id"), F.col("l_partkey").alias("exercise_id"),
            F.col("l_partkey").alias("custom_exercise_id"), "exercise_order", comment.alias("exercise_comment")),
        setup_exercise_details=lambda: sets().select(
            F.col("set_id").alias("id"), F.col("line_id").alias("setup_session_exercise_id"), weight.alias("weight"), "cur_set", goal.alias("reps_goal"),
            F.lit(None).cast("int").alias("myo_order")),
        track_routines=lambda: base.track_routines.withColumn("setup_id", F.when(F.col("id") % 2 == 0, F.col("user_id"))),
        track_days=lambda: paired().select(key.alias("id"), F.col("rk").alias("day_number"), key.alias("track_routine_id"), kept(F.col("day_id")).alias("setup_id")),
        track_sessions=lambda: paired().select(key.alias("id"), key.alias("track_routine_id"), F.coalesce("title", "o_orderpriority").alias("name"),
                                               kept(key).alias("setup_id")),
        track_session_exercises=lambda: lines().select(
            F.col("line_id").alias("id"), F.col("l_orderkey").alias("track_session_id"), F.col("l_partkey").alias("exercise_id"),
            F.col("l_partkey").alias("custom_exercise_id"), "exercise_order", comment.alias("exercise_comment"),
            kept(F.col("line_id"), even, "string").alias("setup_id")),
        track_exercise_details=lambda: sets().select(
            F.col("set_id").alias("id"), F.col("line_id").alias("track_session_exercise_id"), weight.alias("weight"), "cur_set", goal.alias("reps_goal"),
            reps_done.alias("reps_done"), F.lit(None).cast("int").alias("myo_order"), kept(F.col("set_id"), even, "string").alias("setup_id")))
