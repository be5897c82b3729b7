"""All queries of the library proper, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracery.plans import audit, checks, flows, graph, ledger, records, star


def _modules():
    return (star, graph, ledger, audit, flows, records, checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLE
    return found
