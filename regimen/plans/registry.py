"""Registry of named queries: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regimen.plans.oracle import oracle
from regimen.sources.dense import from_driver_dense

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str, sql: str | None = None, dense: bool = False):
    """Register a query; ``sql`` is its DuckDB oracle body (omit when not SQL-expressible).

    ``dense`` registers it once more, as ``<name>_dense``, over the denser model; such a
    function takes the model's source as ``model``."""
    def deco(fn: QueryFn) -> QueryFn:
        _register(name, fn, sql)
        if dense:
            _register(f"{name}_dense", functools.partial(fn, model=from_driver_dense), sql, True)
        return fn
    return deco


def _register(name: str, fn: QueryFn, sql: str | None, dense: bool = False) -> None:
    if name in QUERIES:
        raise KeyError(f"duplicate query {name}")
    QUERIES[name] = fn
    if sql is not None:
        oracle(name, sql, dense)
