"""Request batches derived from the driver tables (deterministic).

Each batch is what many users would send at once; it is a DataFrame that
grows with the tables. The selections by key residue only pick *which* rows
ask for a change; every query still runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators import quality
from regimen.sources.adapter import ROUTINE_PREFIX, driver_table
from regimen.sources.tables import Model

AS_OF = "2024-06-01 12:00:00"
RUN = "r1"


def plan_name(col: str) -> F.Column:
    return F.concat(F.lit(ROUTINE_PREFIX), F.col(col).cast("string"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "customer").select("c_custkey", "c_name")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return driver_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def day_session(m: Model) -> DataFrame:
    """(routine_id, day_number, session_id, session_name) of slot 1."""
    return (m.setup_days.select(F.col("id").alias("day_id"), "day_number",
                                F.col("setup_routine_id").alias("routine_id"))
            .join(m.setup_days_sessions.filter(F.col("session_order") == 1)
                  .select("day_id", "session_id"), "day_id")
            .join(m.setup_sessions.select(F.col("id").alias("session_id"),
                                          F.col("name").alias("session_name")), "session_id"))


def append_exercise_requests(spark, sf) -> DataFrame:
    """I4: two new exercises for every order with o_orderkey % 3 = 0."""
    o = orders(spark, sf).filter(F.col("o_orderkey") % 3 == 0)
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    r = o.select("o_orderkey", "o_custkey", k)
    return r.select((F.col("o_orderkey") * 2 + F.col("k")).alias("request_id"), F.col("k").alias("seq"),
                    F.col("o_orderkey").alias("setup_session_id"),
                    (F.col("o_custkey") + F.col("k")).alias("custom_exercise_id"))


def delete_day_requests(m: Model) -> DataFrame:
    """Delete the days of orders with o_orderkey % 7 = 0."""
    return (m.setup_days.filter(F.col("id") % 7 == 0)
            .select(F.col("setup_routine_id").alias("routine_id"), "day_number"))


def reorder_requests(m: Model) -> DataFrame:
    """Reverse the exercises of sessions with key % 5 = 0 (valid); set every
    new order to 1 in sessions with key % 5 = 1 (invalid unless one exercise)."""
    x = m.setup_session_exercises.select("setup_session_id", "exercise_order")
    n = x.groupBy("setup_session_id").agg(F.count(F.lit(1)).alias("n"))
    x = x.join(n, "setup_session_id")
    valid = x.filter(F.col("setup_session_id") % 5 == 0).select(
        "setup_session_id", F.col("exercise_order").alias("old_order"),
        (F.col("n") + 1 - F.col("exercise_order")).cast("string").alias("new_order"))
    invalid = x.filter(F.col("setup_session_id") % 5 == 1).select(
        "setup_session_id", F.col("exercise_order").alias("old_order"), F.lit("1").alias("new_order"))
    return valid.unionByName(invalid)


def assign_requests(spark, sf, m: Model) -> DataFrame:
    """Day 1 slot 1 <- session of day 2 (update); day 1 slot 2 <- session of
    day 3 (insert); customers % 5 = 0 also ask for an unknown session on day 2."""
    ds = day_session(m)
    c = customers(spark, sf).select(F.col("c_custkey").alias("routine_id"))
    d2 = ds.filter(F.col("day_number") == 2).select("routine_id", F.col("session_name").alias("s2"))
    d3 = ds.filter(F.col("day_number") == 3).select("routine_id", F.col("session_name").alias("s3"))
    j = c.join(d2, "routine_id").join(d3, "routine_id")
    upd = j.select((F.col("routine_id") * 3).alias("request_id"), F.lit(1).alias("seq"), "routine_id",
                   F.lit(1).alias("day_number"), F.lit(1).alias("slot"), F.col("s2").alias("session_name"))
    ins = j.select((F.col("routine_id") * 3 + 1).alias("request_id"), F.lit(2).alias("seq"), "routine_id",
                   F.lit(1).alias("day_number"), F.lit(2).alias("slot"), F.col("s3").alias("session_name"))
    bad = (c.filter(F.col("routine_id") % 5 == 0)
           .select((F.col("routine_id") * 3 + 2).alias("request_id"), F.lit(3).alias("seq"), "routine_id",
                   F.lit(2).alias("day_number"), F.lit(1).alias("slot"),
                   F.lit("No Such Session").alias("session_name")))
    return upd.unionByName(ins).unionByName(bad)


def set_log_lookup(m: Model) -> tuple[DataFrame, DataFrame]:
    """What turns a raw event into a set log: (user_id, n_days), and (user_id, day_number, session_name) of
    slot 1; days are unique (J1)."""
    day = m.setup_days.select(F.col("id").alias("day_id"), "day_number", F.col("setup_routine_id").alias("user_id"))
    first = (m.setup_days_sessions.filter(F.col("session_order") == 1).select("day_id", "session_id")
             .join(m.setup_sessions.select(F.col("id").alias("session_id"), F.col("name").alias("session_name")), "session_id"))
    return (day.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days")),
            day.join(first, "day_id", "left").select("user_id", "day_number", "session_name"))


def as_set_logs(events: DataFrame, counts: DataFrame, days: DataFrame) -> DataFrame:
    """Set logs from raw ``events`` (a batch or a stream): user, day = event_id % days
    + 1, the day's session, exercise 1, set 1; weight = floor(value*2)/2 for even
    ids (else the raw value); reps = props.k. Raw text fields, unvalidated."""
    w = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 2) / 2).otherwise(F.col("value"))
    e = (events.join(counts, "user_id")
         .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                 (F.col("event_id") % F.col("n_days") + 1).cast("int").alias("day_number"),
                 w.cast("string").alias("weight_text"),
                 F.from_json("props", "k string")["k"].alias("reps_text")))
    return (e.join(days, ["user_id", "day_number"], "left")
            .withColumn("routine_name", plan_name("user_id"))
            .withColumn("exercise_order", F.lit(1)).withColumn("set_number", F.lit(1)))


def set_log_events(spark, sf, m: Model) -> DataFrame:
    """The set logs of the ``events`` table."""
    return as_set_logs(driver_table(spark, sf, "events"), *set_log_lookup(m))


def validated_set_log(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted set logs (typed weight and reps) and refused ones with the reason."""
    checked = quality.validated_set_log(events)
    return checked.filter(F.col("problem").isNull()).drop("problem"), checked.filter(F.col("problem").isNotNull())


def rep_goal_requests(m: Model) -> DataFrame:
    """Sessions % 4 = 0 raise every set-1 goal by one (group = session);
    sessions % 8 = 0 carry one bad value, so their whole group is refused."""
    x = (m.setup_session_exercises.filter(F.col("setup_session_id") % 4 == 0)
         .select(F.col("id").alias("sse_id"), "setup_session_id", "exercise_order")
         .join(m.setup_exercise_details.filter(F.col("cur_set") == 1)
               .select(F.col("setup_session_exercise_id").alias("sse_id"), "reps_goal"), "sse_id"))
    bad = (F.col("setup_session_id") % 8 == 0) & (F.col("exercise_order") == 1)
    return x.select(F.col("setup_session_id").alias("request_group"), "sse_id", F.lit(1).alias("set"),
                    F.col("exercise_order").alias("seq"),
                    F.when(bad, F.lit("abc")).otherwise((F.col("reps_goal") + 1).cast("string"))
                    .alias("reps"))


def flag_requests(spark, sf) -> DataFrame:
    c = customers(spark, sf).select(F.col("c_custkey").alias("routine_id"))
    a = c.filter(F.col("routine_id") % 3 == 0).withColumn("action", F.lit("edit_on"))
    b = c.filter(F.col("routine_id") % 3 == 1).withColumn("action", F.lit("edit_off"))
    d = c.filter(F.col("routine_id") % 4 == 0).withColumn("action", F.lit("created"))
    return a.unionByName(b).unionByName(d)


def complete_requests(spark, sf) -> DataFrame:
    """Every user with an open workout of status O completes it."""
    o = orders(spark, sf).filter(F.col("o_orderstatus") == "O")
    return o.select(F.col("o_custkey").alias("user_id"), plan_name("o_custkey").alias("routine_name")).distinct()


def discard_requests(spark, sf) -> DataFrame:
    c = customers(spark, sf).filter(F.col("c_custkey") % 6 == 0)
    return c.select(F.col("c_custkey").alias("user_id"), plan_name("c_custkey").alias("routine_name"))


def delete_routine_requests(spark, sf) -> DataFrame:
    c = customers(spark, sf).filter(F.col("c_custkey") % 10 == 0)
    return c.select(F.col("c_custkey").alias("id"))


def select_routine_requests(spark, sf) -> DataFrame:
    """Every user selects their plan by name; users % 7 = 0 misspell it (case)."""
    c = customers(spark, sf)
    name = F.when(F.col("c_custkey") % 7 == 0, F.lower(plan_name("c_custkey"))).otherwise(plan_name("c_custkey"))
    return c.select(F.col("c_custkey").alias("user_id"), name.alias("routine_name"), F.lit(1).alias("seq"))


def rename_requests(spark, sf, m: Model) -> DataFrame:
    """Customers % 4 = 0 rename day 1's session: an even quotient takes the
    upper-case name of day 2's session (a clash), an odd one 'NEW <key>'."""
    ds = day_session(m)
    c = customers(spark, sf).filter(F.col("c_custkey") % 4 == 0).select(F.col("c_custkey").alias("routine_id"))
    d1 = ds.filter(F.col("day_number") == 1).select("routine_id", "session_id")
    d2 = ds.filter(F.col("day_number") == 2).select("routine_id", F.col("session_name").alias("s2"))
    j = c.join(d1, "routine_id").join(d2, "routine_id", "left")
    even = (F.floor(F.col("routine_id") / 4) % 2) == 0
    new = F.when(even, F.upper("s2")).otherwise(F.concat(F.lit("NEW "), F.col("routine_id").cast("string")))
    return j.select(F.col("routine_id").alias("request_id"), F.lit(1).alias("seq"), "session_id",
                    new.alias("new_name"))


def create_session_requests(spark, sf) -> DataFrame:
    """Customers % 5 = 0 add 'Extra <key>' and, later, 'extra <key>' (a
    batch duplicate); customers % 10 = 0 also send an invalid name."""
    c = customers(spark, sf).filter(F.col("c_custkey") % 5 == 0).select(
        F.col("c_custkey").alias("setup_routine_id"))
    k = F.col("setup_routine_id")
    a = c.select((k * 3).alias("request_id"), F.lit(1).alias("seq"), "setup_routine_id",
                 F.concat(F.lit("Extra "), k.cast("string")).alias("name"))
    b = c.select((k * 3 + 1).alias("request_id"), F.lit(2).alias("seq"), "setup_routine_id",
                 F.concat(F.lit("extra "), k.cast("string")).alias("name"))
    bad = c.filter(k % 10 == 0).select((k * 3 + 2).alias("request_id"), F.lit(3).alias("seq"),
                                       "setup_routine_id", F.lit("  Bad#Name ").alias("name"))
    return a.unionByName(b).unionByName(bad)


def rename_routine_requests(spark, sf) -> DataFrame:
    """I18 (routines): by the customer's key, a new name in blanks, the own name in
    other case, a blank, 101 characters, a bad character, 100 characters."""
    c = customers(spark, sf).select(F.col("c_custkey").alias("routine_id"))
    k, text = F.col("routine_id") % 6, F.col("routine_id").cast("string")
    new = (F.when(k == 0, F.concat(F.lit("  Strength "), text, F.lit(" "))).when(k == 1, F.concat(F.lit("plan "), text)).when(k == 2, F.lit("   "))
           .when(k == 3, F.lit("x" * 101)).when(k == 4, F.lit("a#b")).otherwise(F.lit("y" * 100)))
    return c.select(F.col("routine_id").alias("request_id"), F.lit(1).alias("seq"), "routine_id", new.alias("new_name"))
