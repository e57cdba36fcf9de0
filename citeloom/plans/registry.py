"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import core, files, problems
from citeloom.session import ready

MODULES = (core, files, problems)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: ready(f) for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
