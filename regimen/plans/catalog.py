"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from regimen.plans import q_more, q_outline, q_rules, q_stream, q_transform  # noqa: F401  (registers)
from regimen.plans.oracle import ORACLE
from regimen.plans.registry import QUERIES

FLAGSHIP = "d5_day_outline"

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
