"""All registered queries of the cohort operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwise.plans.chain import Chain

_QUERIES: dict[str, Callable[[Chain], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Chain], DataFrame]], Callable[[Chain], DataFrame]]:
    """Register a query over the derived tables and, if SQL can say it, its twin."""

    def add(make: Callable[[Chain], DataFrame]) -> Callable[[Chain], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is there already")
        _QUERIES[name] = make
        if sql is not None:
            _SQL[name] = sql
        return make

    return add


def _load() -> None:
    from panelwise.plans import aggregates, cohort, disclosure, estimates, exports, gates, joins, profiles, scalars, variants, whole  # noqa: F401


def _runner(make: Callable[[Chain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Chain(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(make) for name, make in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
