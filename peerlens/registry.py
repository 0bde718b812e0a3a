"""The register of queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTER: dict[str, tuple[Query, Callable[[], str] | str | None]] = {}


def query(sql: Callable[[], str] | str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; SQL that is long to make may be given as a function."""

    def add(f: Query) -> Query:
        REGISTER[f.__name__] = (f, sql)
        return f

    return add
