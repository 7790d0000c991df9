"""Sort, limit and paging (F1-F7) for every owner at once.

A page is a column, not a LIMIT/OFFSET: rows get their position inside the
owner (skew-safe ``ordinal``) and ``page = (pos - 1) / size + 1``. A single
user's page is then a filter on (owner, page) that Catalyst pushes down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.operators.nesting import count_days
from regimen.operators.ordinal import ordinal
from regimen.operators.outline import completed_workouts, days_with_sessions
from regimen.sources.schema import DAYS_PER_PAGE, RECORDS_PER_PAGE
from regimen.sources.tables import Model


def page_of(pos: Column, size: int) -> Column:
    return (F.floor((pos - 1) / size) + 1).cast("int")


def slot_row_pages(m: Model, size: int = DAYS_PER_PAGE) -> DataFrame:
    """LIMIT/OFFSET pages of (day, session) rows per routine: a day with two
    sessions takes two places."""
    rows = days_with_sessions(m)
    rows = ordinal(rows, ["routine_id"], ["day_number", F.col("session_order").asc_nulls_last(),
                                          F.col("slot_id").asc_nulls_last()], "row_pos")
    return rows.withColumn("page", page_of(F.col("row_pos"), size))


def day_pages(m: Model, size: int = DAYS_PER_PAGE) -> DataFrame:
    """pages of days (3 per page) per routine."""
    days = m.setup_days.select(F.col("setup_routine_id").alias("routine_id"), F.col("id").alias("day_id"),
                               "day_number")
    days = ordinal(days, ["routine_id"], ["day_number", "day_id"], "day_pos")
    return days.withColumn("page", page_of(F.col("day_pos"), size))


def record_pages(m: Model, size: int = RECORDS_PER_PAGE) -> DataFrame:
    """completed workouts per user, newest first (NULL dates first, as
    PostgreSQL's DESC), with routine id, day and session as tie-break."""
    recs = completed_workouts(m)
    recs = ordinal(recs, ["user_id"], [F.col("completion_date").desc_nulls_first(), "routine_id",
                                       "day_number", "session_name"], "record_pos")
    return recs.withColumn("page", page_of(F.col("record_pos"), size))


def total_pages(n: Column, size: int) -> Column:
    """``max(ceil(n / size), 1)``."""
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def page_after_removal(n: Column, current: Column, size: int) -> Column:
    """``min(ceil(n / size), current)`` (0 when the last row went)."""
    return F.least(F.ceil(n / F.lit(size)), current).cast("int")


def day_page_counts(m: Model, size: int = DAYS_PER_PAGE) -> DataFrame:
    """F5 per routine: total pages of its days."""
    return count_days(m).withColumn("total_pages", total_pages(F.col("total_days"), size))


def record_page_counts(m: Model, size: int = RECORDS_PER_PAGE) -> DataFrame:
    """F5 per user: total pages of completed workouts (users without any: 1)."""
    n = completed_workouts(m).groupBy("user_id").agg(F.count(F.lit(1)).alias("records"))
    return (m.users.select(F.col("id").alias("user_id")).join(n, "user_id", "left")
            .withColumn("records", F.coalesce("records", F.lit(0)).cast("long"))
            .withColumn("total_pages", total_pages(F.col("records"), size)))


def valid_page_requests(requests: DataFrame, totals: DataFrame, owner: str) -> DataFrame:
    """requests (request_id, ``owner``, page text) -> ``valid``: an integer
    in 1..total pages (total pages everywhere, also for the day overview)."""
    from regimen.functions.scalar import to_int
    p = to_int(F.col("page").cast("string"))
    j = requests.join(totals.select(owner, "total_pages"), owner, "left")
    return j.withColumn("valid", F.coalesce(p.isNotNull() & (p >= 1) & (p <= F.col("total_pages")),
                                            F.lit(False)))


def sorted_names(df: DataFrame, owner: str, name: str, out: str = "pos") -> DataFrame:
    """alphabetical list per owner (binary collation) as positions."""
    return ordinal(df, [owner], [name, "id"] if "id" in df.columns else [name], out)
