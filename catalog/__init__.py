"""Registered queries over the benchmark tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    from . import files, membership, models, panel, portfolio, runlog, text

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (panel, membership, portfolio, runlog, text, files, models):
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
