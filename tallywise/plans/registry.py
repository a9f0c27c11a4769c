"""Registered queries of the claim-checking operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL for its rows (over the views and the given tables)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["slice_found_where_claimed"](spark, sf_dir)


from . import answer_queries, claims_queries, evaluation_queries, filing_queries, function_queries, ledger_queries, report_queries, results_queries  # noqa: E402, F401
