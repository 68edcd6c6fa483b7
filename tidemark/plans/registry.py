"""A small registry: a query takes its tables by name, so that only those it uses are read."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator). The decorated function's parameters name the tables it reads; ``spark`` and ``sf_dir`` are themselves."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f: Callable[..., DataFrame]):
            tables = list(inspect.signature(f).parameters)

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                given = {"spark": spark, "sf_dir": sf_dir}
                return f(*(given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

            run.__name__ = f.__name__
            queries[f.__name__] = run
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query
