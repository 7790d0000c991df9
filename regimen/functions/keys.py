"""Deterministic keys (H6).

A new row's id is a hash of (run, entity, source keys). A child computes its
parent's new id from the parent's source key, so the six snapshot tables are
independent projections: no ``RETURNING``, no write order, and a retried task
produces the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_id(run: str | Column, entity: str, *parts) -> Column:
    """``sha2('run|entity|part1|part2...', 256)``; parts are column names or Columns."""
    run_col = run if isinstance(run, Column) else F.lit(run)
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.sha2(F.concat_ws("|", run_col.cast("string"), F.lit(entity),
                              *[c.cast("string") for c in cols]), 256)
