"""Registry of the named queries exposed to ``__spark_entry__``.

A query is ``fn(spark, sf_dir) -> DataFrame``.  ``sql`` is the equivalent
DuckDB text over the same tables (views named like the parquet files); it
is omitted for jobs with no SQL form (iterative training, Spark ML fits),
which are checked by pytest instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def sql_list(values) -> str:
    """A DOUBLE[] literal for DuckDB text."""
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"
