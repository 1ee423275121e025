"""Registration of queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues after the common table expressions."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{views.SQL}{sql}" if sql.startswith(",") else f"{views.SQL}\n{sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.withColumns({n: F.round(n, digits) for n in names})
