"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeglass.plans import queries_more, queries_relational, queries_sources, queries_sql, queries_stored, queries_streaming, queries_text

_MODULES = (queries_text, queries_relational, queries_more, queries_sources, queries_streaming, queries_sql, queries_stored)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """All articles scored by the whole plan."""
    return queries()["p13_article_scoring"](spark, folder)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
