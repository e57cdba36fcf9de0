"""The package's queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.queries import QUERIES
from citeloom.llm.sql import SQL
from citeloom.session import ready


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: ready(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
