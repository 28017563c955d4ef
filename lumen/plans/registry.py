"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Each query runs one operator of the library over whole driver tables (or
inputs Spark derives from them). ``ORACLE`` holds the DuckDB SQL that must
give the same relation; operators that cannot be written in SQL (forests,
streams) have no entry and get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module (each registers itself) and return both maps."""
    from lumen.plans import q_catalog, q_clean, q_io, q_model, q_profile, q_risk  # noqa: F401
    return QUERIES, ORACLE
