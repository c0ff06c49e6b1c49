"""All queries outside the llm subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import entities, equity, extras, indexes, models, portfolio, problems, relational, statistics

MODULES = [problems, relational, statistics, entities, portfolio, extras, models, indexes, equity]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
