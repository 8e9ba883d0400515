"""Every query of the engine by name, with the equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fact_queries, scale_queries, story_queries, text_queries

QUERIES: dict = text_queries.QUERIES | fact_queries.QUERIES | story_queries.QUERIES | scale_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | fact_queries.ORACLE_SQL | story_queries.ORACLE_SQL | scale_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' located-in sentences, from claim to answer with citation."""
    return fact_queries.answers_citations(spark, sf_dir)
