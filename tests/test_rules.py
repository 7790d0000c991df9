"""Validation rules and scalar functions on edge values."""

from pyspark.sql import functions as F

from regimen.functions import scalar as H
from regimen.operators import quality as J
from regimen.sources.seed import seed_model


def _one(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_null_never_collides_in_unique_keys(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 2, 1), ("a", 2, 1)],
                               "p string, s int, m int")
    dup = J.duplicate_keys(df, ["p", "s", "m"]).collect()
    assert [(r.key, r.detail) for r in dup] == [("a|2|1", "2")]


def test_lower_names_unique_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "Push"), (1, "push"), (1, None), (1, None), (2, "push")],
                               "o int, name string")
    assert [r.key for r in J.duplicate_lower_names(df, "o", "name").collect()] == ["1|push"]


def test_weight_rule(spark):
    got = _one(spark, ["12.3", "-1", "10000", "abc", "", "12.5", "0"], J.weight_problem)
    assert got == ["weight:not_a_half_step", "weight:not_a_number",
                   "weight:out_of_range", "weight:not_a_number",
                   "weight:not_a_number", None, None]


def test_reps_rules_and_integer_parse(spark):
    assert _one(spark, ["1.0", "1e1", " 5 ", "0", "-2", None], H.to_int) == [None, None, 5, 0, -2, None]
    assert _one(spark, ["0", "1", "x"], lambda c: J.reps_problem(c, 1)) == [
        "reps:not_an_integer_from_1", None, "reps:not_an_integer_from_1"]


def test_name_rule(spark):
    got = _one(spark, ["Push ups", "a%b", "a_b", "line\n", " ok ", "", "x" * 256, "(A)+-1"], J.name_problem)
    bad_chars = "name:bad_character"
    assert got == [None, bad_chars, bad_chars, None, None, "name:empty", "name:too_long", None]


def test_whole_match_rejects_trailing_newline(spark):
    from regimen.sources.schema import NAME_PATTERN
    assert _one(spark, ["abc", "abc\n"], lambda c: H.matches_whole(c, NAME_PATTERN)) == [True, False]


def test_set_log_needs_both_values(spark):
    df = spark.createDataFrame([("10", ""), ("", "5"), ("10", "5"), ("10.2", "5")], "w string, r string")
    got = [r[0] for r in df.select(J.set_log_problem(F.col("w"), F.col("r"))).collect()]
    assert got == ["set:incomplete", "set:incomplete", None,
                   "weight:not_a_half_step"]


def test_local_date_and_field_names(spark):
    df = spark.createDataFrame([("2024-03-10 07:30:00",), (None,)], "t string") \
        .select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(H.local_date("t")).collect()] == ["03/09/2024", None]
    f = spark.createDataFrame([("day12_session3_x",), ("order-4",)], "f string")
    row = f.select(H.field_day_number("f"), H.field_session_number("f"), H.is_day_field("f"),
                   H.split_part("f", "-", 1)).collect()
    assert tuple(row[0]) == (12, 3, True, None)
    assert tuple(row[1]) == (None, None, False, "4")


def test_seed_model_has_no_violations_except_empty_catalog(spark):
    m = seed_model(spark)
    bad = J.model_violations(m).collect()
    assert bad == []
    assert J.empty_routines(m).count() == 0


def test_keys_are_counted_where_their_rows_stand(spark):
    """A key that holds the column by which its rows are dealt needs no exchange of its own; counts, NULLs and texts of other types stay."""
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, None), (2, 1, 1.0), (2, None, 1.0), (2, None, 1.0)], "s int, o int, w double")
    keys = [(rule, [F.col(c) for c in cols], [F.col(c) for c in cols]) for rule, cols in (("a", ["s"]), ("b", ["s", "o"]), ("c", ["s", "w"]))]
    report = J.repeated_keys(rows.repartition(4, "s"), keys, "t")
    got = sorted((r.rule, r.key, r.detail) for r in report.collect())
    assert got == [("a", "1", "3"), ("a", "2", "3"), ("b", "1|1", "2"), ("c", "1|0.5", "2"), ("c", "2|1.0", "3")]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "struct<" not in plan


def test_rows_that_keep_the_rules_get_no_entries(spark):
    """J4 and J5 build report entries of broken rows only, several of a row."""
    df = spark.createDataFrame([("a", 1), ("b", 0), (None, -1), ("c", None)], "id string, n int")
    report = J.row_rules(df, [("n", ">", 0)], ["id", "n"], "t")
    assert sorted((r.rule, r.key or "", r.detail) for r in report.collect()) == [
        ("check", "-1", "n > 0"), ("check", "0", "n > 0"), ("not_null", "", "id"), ("not_null", "c", "n")]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter", plan.index("Generate")) and "lambda" not in plan


def test_referenced_keys_are_counted_once_in_their_own_type(spark):
    """J1 and J3 of a referenced key come from one count: doubled and missing parents, and NULLs, among whole-number and text keys."""
    m = seed_model(spark)
    users, sets = m.users, m.track_exercise_details
    rows = spark.createDataFrame([("a", "s1", 1, None, 1, None, None), ("a", "s1", 1, None, 2, None, None)], m.track_session_exercises.schema)
    parts = spark.createDataFrame([(f"p{k}", sse, None, k, 1, None, None, None) for k, sse in enumerate(["a", "a", "b", "b", None], 1)], sets.schema)
    m = m.replace(users=users.unionByName(users), track_session_exercises=rows, track_exercise_details=parts)
    bad = J.model_violations(m)
    got = sorted((r.rule, r.table, r.key, r.detail) for r in bad.collect())
    ids = [str(r.id) for r in users.collect()]
    assert [g for g in got if g[1] == "users" and g[0] == "primary_key"] == sorted(("primary_key", "users", k, "2") for k in ids)
    assert ("primary_key", "track_session_exercises", "a", "2") in got
    assert [g[2:] for g in got if g[:2] == ("foreign_key", "track_exercise_details")] == [("b", "track_session_exercise_id")] * 2
    assert [g[2:] for g in got if g[:2] == ("foreign_key", "track_session_exercises")] == [("1", "exercise_id")] * 2 + [("s1", "track_session_id")] * 2
    assert sorted((r.rule, r.table, r.key, r.detail) for r in J.all_dangling_references(m).collect()) == [g for g in got if g[0] == "foreign_key"]
    assert "parent#" not in bad._jdf.queryExecution().optimizedPlan().toString()           # no entries of all keys under one number and text


def test_equal_keys_of_two_tables_are_counted_in_one_stage(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ids = spark.range(100).selectExpr("id % 60 AS id")
        report = J.duplicate_keys(ids, ["id"], "plan").unionByName(J.duplicate_keys(ids, ["id"], "log"))
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") == 2 and "ReusedExchange" in plan                # one count, partial and final
        assert sorted({(r.table, r.detail) for r in report.collect()}) == [("log", "2"), ("plan", "2")] and report.count() == 80
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
