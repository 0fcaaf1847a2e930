"""The registry of named queries: each is a Spark plan, most with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from docketry.plans import basics, domain, evidence, history, more, presentation, reports, scores, services, views  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: organisations ranked by overall score, with stars."""
    from docketry.plans import domain, local

    return domain.entry(local.Tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
