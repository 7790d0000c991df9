from pyspark.sql import functions as F

from regimen.llm import frames


def test_salted_join_is_the_plain_one_and_splits_hot_keys(spark):
    """A key with a third of the rows, also one that the other side doesn't have; keys of two columns; equal rows stay."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, 8).otherwise(F.col("id")).alias("k"),
                                    F.lit("x").alias("j"), "id")
    rows = rows.unionByName(rows.where("id % 500 = 0"))
    unique = rows.where("k <> 8").groupBy("k", "j").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = frames.join_salted(rows, frames.stored(unique), ["k", "j"])
    assert sorted(got.columns) == ["id", "j", "k", "top"]
    columns = ["k", "j", "id", "top"]
    want = rows.join(unique.drop("n"), ["k", "j"])
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__salts" in text
    empty = unique.where("false")
    assert frames.join_salted(rows, frames.stored(empty), ["k", "j"]).count() == 0


def test_no_more_than_four_hot_keys_a_partition(spark):
    parts = frames.shuffle_partitions(spark)
    unique = spark.range(1000).select("id", (F.col("id") * F.col("id")).alias("n"))
    total = unique.agg(F.sum("n")).first()[0]
    assert unique.where(F.col("n") > total // (4 * parts) + 1).count() < 4 * parts
