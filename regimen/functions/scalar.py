"""Scalar column functions (H1-H15). All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from regimen.sources.schema import DATE_FORMAT, DISPLAY_TZ


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lower(x) -> Column:
    """H1."""
    return F.lower(_c(x))


def to_instant(text) -> Column:
    """H4: text -> timestamptz; unparsable text gives NULL."""
    return F.try_to_timestamp(_c(text))


def local_date(ts, tz: str = DISPLAY_TZ, fmt: str = DATE_FORMAT) -> Column:
    """H8: instant -> local calendar date text (MM/dd/yyyy); NULL stays NULL."""
    return F.date_format(F.from_utc_timestamp(_c(ts).cast("timestamp"), tz), fmt)


def js_trim(x) -> Column:
    """H9: strip leading/trailing whitespace (all of \\s, like String.prototype.trim)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def field_day_number(field) -> Column:
    """``day(\\d+)_`` capture of a form field name (NULL if absent)."""
    return F.nullif(F.regexp_extract(_c(field), r"day(\d+)_", 1), F.lit("")).cast("int")


def field_session_number(field) -> Column:
    """``session(\\d+)`` capture."""
    return F.nullif(F.regexp_extract(_c(field), r"session(\d+)", 1), F.lit("")).cast("int")


def split_part(field, sep: str, index: int) -> Column:
    """N-th (0-based) piece of a field name split on a literal separator."""
    return F.get(F.split(_c(field), re.escape(sep)), index)


def is_day_field(field) -> Column:
    """Field name starts with 'day'."""
    return _c(field).startswith("day")


def matches_whole(x, pattern_body: str) -> Column:
    """Whole-string regex match (``\\A...\\z``: a trailing newline does not pass)."""
    return _c(x).rlike(pattern_body)


def goal_display(reps) -> Column:
    """H14: '-' for a missing or zero goal."""
    return F.when(_c(reps).isNull() | (_c(reps) == 0), F.lit("-")).otherwise(_c(reps).cast("string"))


def reps_label(reps) -> Column:
    """H14: 'Rep' / 'Reps' after a count; 'N/A' when missing."""
    return (F.when(_c(reps).isNull(), F.lit("N/A"))
            .when(_c(reps) == 1, F.lit("1 Rep"))
            .otherwise(F.concat(_c(reps).cast("string"), F.lit(" Reps"))))


def to_int(text) -> Column:
    """Strict integer parse: ' 5 ' -> 5; '1.0', '1e1', 'abc', '' -> NULL."""
    t = js_trim(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def to_weight(text) -> Column:
    """Weight text -> decimal(6,2); NULL when not a number or out of range."""
    t = js_trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("decimal(6,2)"))
