"""All queries of the engine by name, with the SQL each one is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Modules that register queries as they are imported.
MODULES = ("operators.retrieval", "operators.chunking", "operators.gate", "operators.prompts", "operators.scoring", "operators.extraction", "operators.cleaning", "operators.question", "operators.comparison", "operators.sections", "operators.relational", "plans.runs", "streaming.turns")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"answerloom.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
