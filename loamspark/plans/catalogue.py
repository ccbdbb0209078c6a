"""All registered queries of the engine, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_queries, context_queries, stem_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (text_queries, context_queries, stem_queries, block_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
