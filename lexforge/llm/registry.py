"""Queries and SQL of this subpackage, one module per operator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality", "tokencount", "linedup", "packing", "htmltext", "sketch", "toxicity", "decontaminate", "licences", "neardup", "repair", "audit", "lm")


def _modules():
    return [importlib.import_module(f"lexforge.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in getattr(m, "ORACLE_SQL", {}).items()}
