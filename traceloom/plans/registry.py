"""Every query of the trace library, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL. Doubles are rounded at the edge, in both, and integers are long."""

    def register(function: Query) -> Query:
        FOUND[function.__name__] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def rounded(rows: DataFrame) -> DataFrame:
    shown = {"double": lambda c: F.round(F.col(c), PLACES).alias(c), "int": lambda c: F.col(c).cast("long").alias(c)}
    return rows.select(*[shown.get(t, F.col)(c) for c, t in rows.dtypes])


def load() -> None:
    from traceloom.plans import flows, programs, recorded, scores, texts, traces  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    load()
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
