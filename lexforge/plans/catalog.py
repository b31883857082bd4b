"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("citations", "finding", "prose", "words", "privacy", "reports", "traffic")


def _modules():
    return [importlib.import_module(f"lexforge.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
