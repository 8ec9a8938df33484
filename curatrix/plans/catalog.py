"""The query catalogue over the driver's tables, and the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.plans import record_queries, text_queries, vector_queries
from curatrix.plans.registry import Query

_PARTS = (vector_queries.R, text_queries.R, record_queries.R)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of the benchmark passages over all documents."""
    return text_queries.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
