"""Registered queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is DuckDB's statement of it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


from marlstone.plans import advisories as advisories  # noqa: E402
from marlstone.plans import catalog as catalog  # noqa: E402
from marlstone.plans import code as code  # noqa: E402
from marlstone.plans import matching as matching  # noqa: E402
from marlstone.plans import ordered as ordered  # noqa: E402
from marlstone.plans import reports as reports  # noqa: E402
from marlstone.plans import sweep as sweep  # noqa: E402
from marlstone.plans import text as text  # noqa: E402
from marlstone.plans import views as views  # noqa: E402
