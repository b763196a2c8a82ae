"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import derive, derive_sql, feeds, feeds_sql, imports, imports_sql, queries, sql

__all__ = ["QUERIES", "SQL", "flagship"]

QUERIES = queries.QUERIES | derive.QUERIES | feeds.QUERIES | imports.QUERIES
SQL = sql.SQL | derive_sql.SQL | feeds_sql.SQL | imports_sql.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["amenity_score_top20"](spark, sf_dir)
