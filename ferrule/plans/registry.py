"""Queries of the core library, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.operators import error_parse, list_split
from ferrule.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.tracker_rejects(table(spark, d, "tracker_lines"), table(spark, d, "states")).select("line_no", "reason").distinct()


@query("p2_edits")
def p2_edits(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.tracker_rejects(table(spark, d, "tracker_lines"), table(spark, d, "states"))


@query("p2_loaded")
def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.tracker_loaded(table(spark, d, "tracker_lines"), table(spark, d, "states"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return list_split.split_values(table(spark, d, "applications"), "id", "notes").distinct()
