"""All queries of the engine's own operators, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES (name to callable) and SQL (name to text).
MODULES: list[str] = ["tessera.plans.q_statistics", "tessera.plans.q_molecules", "tessera.plans.q_models", "tessera.plans.q_tables"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= __import__(name, fromlist=["QUERIES"]).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= __import__(name, fromlist=["SQL"]).SQL
    return found
