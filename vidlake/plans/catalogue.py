"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidlake.plans import compare_queries, evaluation_queries, event_queries, gallery_queries, library_queries, selection_queries, track_queries, tube_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (event_queries, track_queries, evaluation_queries, library_queries, gallery_queries, selection_queries, tube_queries, compare_queries)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
