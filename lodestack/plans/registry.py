"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basket_queries, extra_queries, graph_queries, report_queries, term_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (basket_queries, text_queries, graph_queries, extra_queries, report_queries, term_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
