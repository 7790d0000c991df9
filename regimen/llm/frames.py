"""Spark helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regimen.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id; with doc_id the key of a row. Null differs from empty."""
    return F.xxhash64(text, text.isNull())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` (stored, with short rows) hinted for broadcast if its counted rows are few; else as it is, for
    the planner to shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


def join_salted(rows: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (stored; one row a key, without nulls, with the number ``n`` of the key's rows),
    without ``n``. A key with more rows than a quarter of an even partition is dealt over as many salts as it has such
    quarters, and its one row repeated for each. No more than four keys a partition can be so hot: they are broadcast."""
    parts = shuffle_partitions(rows.sparkSession)
    total = unique.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quarter = int(total) // (4 * parts) + 1
    salts = F.ceil(F.col("n") / quarter).cast("int")
    hot = F.broadcast(unique.where(F.col("n") > quarter).select(*keys, salts.alias("__salts")))        # fewer than 4 * parts rows
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    each = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > quarter, salts - 1).otherwise(0)))).drop("n")
    return dealt.join(each, [*keys, "__salt"]).drop("__salt")


#: bits of a bitmap of keys: at least, and at most (16 MiB); beyond that it only filters less
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
_PAGE = 1 << 15


def bitmap_of(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(pages of a bitmap of the 64-bit hashes in ``column``, number of bits), with some 16 bits a key."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * keys.count()):
        bits *= 2
    place = f"pmod({column}, {bits}L)"
    pages = (keys.select(F.expr(f"int({place} / {_PAGE})").alias("__page"), F.expr(f"pmod({place}, {_PAGE}L)").alias("at"))
             .groupBy("__page").agg(F.expr("bitmap_construct_agg(at)").alias("__bitmap")))
    return stored(pages), bits


def maybe_in(rows: DataFrame, column: str, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` whose ``column`` is among the keys of ``bitmap``, and a few others; an exact join has to follow.
    (An inner one: the optimizer would move a semi join below this filter.)"""
    pages, bits = bitmap
    place = f"pmod({column}, {bits}L)"
    byte = F.conv(F.hex(F.expr(f"substring(__bitmap, int(pmod({place}, {_PAGE}L) / 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr(f"(shiftright(__byte, int(pmod({column}, 8L))) & 1) = 1")
    return (rows.withColumn("__page", F.expr(f"int({place} / {_PAGE})")).join(F.broadcast(pages), "__page")
            .withColumn("__byte", byte).where(hit).drop("__page", "__bitmap", "__byte"))
