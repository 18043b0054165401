"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import curation_queries, document_queries, export_queries, function_queries, graph_queries, library_queries, metadata_queries, search_queries, source_queries, text_queries

_MODULES = (search_queries, graph_queries, curation_queries, text_queries, metadata_queries, function_queries, library_queries, source_queries, export_queries, document_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
