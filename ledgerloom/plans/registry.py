"""Named queries of the engine and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Domain], DataFrame]], Callable[[Domain], DataFrame]]:
    """Register a function of the tables; sql, where SQL can express it, gives the same rows."""

    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return add


from . import aggregates, api, changes, console, io, joins, mapping, marts, projections, quality, runs, vendors, windows  # noqa: E402, F401  (they register their queries)
