"""All queries of the library, with the SQL that DuckDB checks them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe import session
from chronoframe.plans import composed, relational
from chronoframe.plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]


def _relational(name: str) -> Query:
    text = relational.texts(name)[0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if tables := relational.tables_of(text):
            session.views(spark, sf_dir, *tables)
        return Engine(spark, "").sql(text) if name.startswith("fn_") else spark.sql(text)  # functions in the engine's meaning

    return run


def queries() -> dict[str, Query]:
    return {name: _relational(name) for name in relational.SQL} | {name: run for name, (run, _) in composed.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: relational.texts(name)[1] for name in relational.SQL} | {name: sql for name, (_, sql) in composed.QUERIES.items() if sql}
