"""Positions inside a group (row_number per owner) that survive hot owners.

``Window.partitionBy(owner)`` sends a whole owner to one task. That is the
cheapest plan while every owner fits one task, and a straggler (or a failed
task) once one owner holds a third of all rows. ``ordinal`` therefore first
measures the largest group exactly (one aggregate job: partial counts, one
row per group shuffled) and

* bounded groups -> the plain window (one shuffle);
* a hot group -> the split plan:

  1. range-partition by (keys, order), which cuts a hot owner into many
     ranges, and materialise that once with a reliable ``checkpoint`` in the
     shared checkpoint folder (range bounds come from sampling; two
     evaluations of the exchange could cut differently, so every later pass
     must read the same materialised partitions);
  2. number rows inside each (range partition, owner) piece;
  3. add, per piece, the rows of the same owner in earlier partitions. Only
     an owner that is the last of one partition and the first of the next
     can cross a boundary, so the carry table has at most 2(P-1) rows and
     broadcasting it has a proven bound.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimen.session import checkpoint_dir

_PID, _LRN, _N, _OFF = "_ord_pid", "_ord_lrn", "_ord_n", "_ord_off"
HOT_ROWS_CONF = "spark.regimen.ordinal.hotRows"
HOT_ROWS_DEFAULT = 1_000_000
# hashed groups that are measured first
TOGETHER = 1 << 16
# auto (measure) | split (always the hot-group plan) | window (always the plain window)
STRATEGY_CONF = "spark.regimen.ordinal.strategy"


def _cols(items) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in items]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_rows(spark) -> int:
    """Rows one task may hold for one group (``spark.regimen.ordinal.hotRows``);
    0 when the strategy is forced to the split plan."""
    if spark.conf.get(STRATEGY_CONF, "auto") == "split":
        return 0
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def groups_bounded(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when no ``keys`` group of ``df`` exceeds what one task should hold:
    ``limit`` rows, by default the hot-row limit (absolute: it grows neither
    with the data nor with the number of partitions)."""
    if limit is None:
        limit = int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
    # groups put together by hash are at least as large: where these fit, no row per group is shuffled
    together = df.select(F.pmod(F.xxhash64(*keys), F.lit(TOGETHER)).alias("_g"))
    return largest_group(together, ["_g"]) <= limit or largest_group(df, keys) <= limit


def in_one_window(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether ``ordinal`` numbers ``df`` by the plain window: as forced, or as the groups measure."""
    forced = df.sparkSession.conf.get(STRATEGY_CONF, "auto")
    return forced == "window" if forced != "auto" else groups_bounded(df, keys)


def largest_group(*measured) -> int:
    """Rows of the largest ``keys`` group of ``df``, for arguments ``df, keys``; for
    several ``(df, keys)`` pairs (levels of a hierarchy, each one narrow scan)
    the product of their largest groups, which bounds the groups of their
    join. One job; an empty table counts as 1."""
    if isinstance(measured[0], DataFrame):
        measured = [(measured[0], measured[1])]
    counts = None
    for k, (df, keys) in enumerate(measured):
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
        counts = n if counts is None else counts.unionByName(n)
    bound = 1
    for row in counts.groupBy("k").agg(F.max("n").alias("n")).collect():       # one row per pair
        bound *= row["n"]
    return bound


def largest_sum(counts: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest ``keys`` group, from ``counts`` with a column ``n`` of row counts rolled up from below: exact
    for the join they stand for, at the cost of one aggregate. An empty table counts as 1."""
    top = counts.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]      # one row
    return 1 if top is None else int(top)


def proven_bounded(spark, *measured) -> bool:
    """Whether base tables prove that every group of their join fits one task."""
    return largest_group(*measured) <= hot_rows(spark)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys match each other, as the groups of a window do."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "ordinal",
            partitions: int | None = None, bounded: bool | None = None) -> DataFrame:
    """Add ``name`` = 1..n position of each row inside its ``keys`` group.

    ``order`` (names or sort Columns) must be a total order inside a group
    (add a unique tie-break), otherwise ties get an arbitrary but dense
    numbering. A NULL key is a group like any other, in both plans. ``bounded``: None measures the
    groups; True / False is the caller's proven answer (e.g. measured on a
    coarser key). The measurement and the split plan's checkpoint run a job
    when called; the rest stays lazy.
    """
    keys = list(keys)
    order_cols = _cols(order)
    forced = df.sparkSession.conf.get(STRATEGY_CONF, "auto")
    if forced != "auto":
        bounded = forced == "window"
    elif bounded is None:
        bounded = groups_bounded(df, keys)
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.withColumn(name, F.row_number().over(w).cast("int"))
    return _split_ordinal(df, keys, order_cols, name, partitions or _partitions(df))


def cut_ranges(df: DataFrame, keys: list[str], order_cols: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` cut into ``n`` ranges of (keys, order), stored once, with the range's number; the rows of the fewer
    than n groups that stand in several ranges). Such a group is the first or the last one of each of its ranges."""
    checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *_cols(keys), *order_cols)
              .withColumn(_PID, F.spark_partition_id())
              .checkpoint(eager=True))
    ends = ranged.groupBy(_PID).agg(F.min(F.struct(*keys)).alias("_lo"), F.max(F.struct(*keys)).alias("_hi"))     # n rows
    ends = ends.select(_PID, F.explode(F.array("_lo", "_hi")).alias("_k")).select(_PID, *[F.col("_k")[k].alias(k) for k in keys])
    several = ends.groupBy(*keys).agg(F.min(_PID).alias("_a"), F.max(_PID).alias("_b")).filter("_a < _b").select(*keys)
    return ranged, join_null_safe(ranged, F.broadcast(several), keys, "left_semi")


def _split_ordinal(df: DataFrame, keys: list[str], order_cols: list[Column], name: str,
                   n: int) -> DataFrame:
    ranged, crossing = cut_ranges(df, keys, order_cols, n)
    local = ranged.withColumn(
        _LRN, F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(*order_cols)))
    pieces = crossing.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias(_N))           # <= 2P rows
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = (pieces.withColumn(_OFF, F.sum(_N).over(before))
             .filter(F.col(_OFF).isNotNull()).select(_PID, *keys, _OFF))
    return (join_null_safe(local, F.broadcast(carry), [_PID, *keys], "left")
            .withColumn(name, (F.col(_LRN) + F.coalesce(F.col(_OFF), F.lit(0))).cast("int"))
            .drop(_PID, _LRN, _OFF))


def split_runs(df: DataFrame, keys: Sequence[str], run_cols: Sequence[str], order: Sequence, run_name: str, item_name: str,
               partitions: int | None = None) -> DataFrame:
    """``run_name`` and ``item_name``: the run of adjacent rows (by ``order``, a ``keys`` group) with equal ``run_cols``, and the
    place in it, by a segmented scan over one range cut.

    Each range numbers its own runs as if nothing stood before it. A piece (the rows of one group in one range) is then
    summed up by its first and last values, its number of runs and the length of its last run. Two summaries next to each
    other join if the last values of one are the first of the other, and a piece that is one run hands the run before it on;
    both are running sums over the pieces of a group, of which there are at most 2P in all, so the carry is broadcast.
    """
    keys, run_cols, order_cols = list(keys), list(run_cols), _cols(order)
    ranged, crossing = cut_ranges(df, keys, order_cols, partitions or _partitions(df))
    piece = Window.partitionBy(_PID, *keys).orderBy(*order_cols)
    values = F.struct(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(run_cols)])
    starts = F.when(F.lag(F.lit(1)).over(piece).isNull() | ~F.lag(values).over(piece).eqNullSafe(values), 1).otherwise(0)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_start", starts).withColumn(
            "_run", F.sum("_start").over(piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    in_run = Window.partitionBy(_PID, *keys, "_run").orderBy(*order_cols)
    local = numbered(ranged).withColumn("_item", F.row_number().over(in_run))

    tails = numbered(crossing).groupBy(_PID, *keys, "_run").agg(F.count(F.lit(1)).alias("_len"), F.first(values).alias("_v"))
    pieces = tails.groupBy(_PID, *keys).agg(
        F.max("_run").alias("_runs"), F.max_by("_len", "_run").alias("_len"),
        F.min_by("_v", "_run").alias("_first"), F.max_by("_v", "_run").alias("_last"))                      # <= 2P rows
    group = Window.partitionBy(*keys).orderBy(_PID)
    earlier, to_here = group.rowsBetween(Window.unboundedPreceding, -1), group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = F.lag(F.lit(1)).over(group).isNotNull() & F.lag("_last").over(group).eqNullSafe(F.col("_first"))
    carry = (pieces.withColumn("_joined", joined)
             .withColumn("_chain", F.sum(F.when(F.col("_joined") & (F.col("_runs") == 1), 0).otherwise(1)).over(to_here))
             .withColumn("_open", F.sum("_len").over(Window.partitionBy(*keys, "_chain").orderBy(_PID)
                                                     .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("_items", F.when(F.col("_joined"), F.lag("_open").over(group)).otherwise(0))
             .withColumn("_before", F.coalesce(F.sum("_runs").over(earlier), F.lit(0)) - F.sum(F.col("_joined").cast("int")).over(to_here))
             .select(_PID, *keys, "_items", "_before"))
    open_items = F.when(F.col("_run") == 1, F.coalesce("_items", F.lit(0))).otherwise(0)
    return (join_null_safe(local, F.broadcast(carry), [_PID, *keys], "left")
            .withColumn(run_name, (F.col("_run") + F.coalesce("_before", F.lit(0))).cast("int"))
            .withColumn(item_name, (F.col("_item") + open_items).cast("int"))
            .drop(_PID, "_start", "_run", "_item", "_items", "_before"))


def count_before(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str,
                 left_id: str, name: str = "n_before", inclusive: bool = False,
                 bounded: bool | None = None) -> DataFrame:
    """For each ``left`` row, the number of ``right`` rows of the same ``keys``
    group whose ``value`` is < (``inclusive``: <=) the left row's value.

    A range count without pairs: left and right rows are numbered together
    and left rows alone; the difference of the two positions is the count of
    right rows in front. Both steps are ``ordinal``, so hot groups split.
    ``left_id`` must be unique inside a group. Left rows travel as a struct, so
    they are not joined back; NULL keys are a group, a NULL value counts 0 on
    the left and is not counted on the right.
    """
    keys = list(keys)
    kind = 1 if inclusive else 0          # left sorts after (inclusive) or before equal rights
    lsel = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), F.lit(kind).alias("_k"),
                       F.col(left_id).cast("string").alias("_id"), F.struct(*left.columns).alias("_row"))
    rsel = right.filter(F.col(value).isNotNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), F.lit(1 - kind).alias("_k"),
        F.lit(None).cast("string").alias("_id"), F.lit(None).cast(lsel.schema["_row"].dataType).alias("_row"))
    both = lsel.unionByName(rsel)
    keys = [f"_k_{k}" for k in keys]
    forced = both.sparkSession.conf.get(STRATEGY_CONF, "auto")
    if forced != "auto":
        bounded = forced == "window"
    elif bounded is None:
        bounded = groups_bounded(both, keys)
    if bounded:
        # one running sum of right rows in (value, kind) order: one exchange, one window
        run = Window.partitionBy(*keys).orderBy("_v", "_k", "_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        is_right = F.when(F.col("_k") == 1 - kind, 1).otherwise(0)
        counted = both.withColumn("_n", F.sum(is_right).over(run)).filter(F.col("_k") == kind)
    else:
        both = ordinal(both, keys, ["_v", "_k", "_id"], "_p", bounded=bounded)
        counted = (ordinal(both.filter(F.col("_k") == kind), keys, ["_v", "_id"], "_q", bounded=bounded)
                   .withColumn("_n", F.col("_p") - F.col("_q")))
    return counted.select("_row.*", F.col("_n").cast("long").alias(name))
