"""Queries with the same columns and types on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.plans.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, columns: str, views: str = "", sql: str | None = None):
    """Registers f(views) as a query with `columns` (name:type; s string, l bigint, d double rounded to 6 places, b boolean) and its SQL over `views`."""
    spec = [c.split(":") for c in columns.split()]

    def add(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            kinds = {"s": "string", "l": "bigint", "b": "boolean"}
            return df.select(*[(F.round(F.col(c).cast("double"), 6) + 0.0 if k == "d" else F.col(c).cast(kinds[k])).alias(c) for c, k in spec])

        QUERIES[name] = run
        if sql:
            kinds = {"s": "VARCHAR", "l": "BIGINT", "b": "BOOLEAN"}
            cast = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if k == "d" else f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in spec)
            ORACLE[name] = f"SELECT {cast} FROM (\n{with_views(views, sql)}\n) answer"
        return f

    return add
