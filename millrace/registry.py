"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import tuned

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``f(spark, sf_dir)`` under a name, with SQL for DuckDB if it can say the same."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tuned(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Temporary views over the tables of a folder; nothing is read but footers."""
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that is one statement of our SQL front end.

    ``oracle``: DuckDB's form; the same text if it is "same".
    """
    from millrace.plans.dialect import run_sql

    @query(name, text if oracle == "same" else oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(views(spark, sf_dir), text)
