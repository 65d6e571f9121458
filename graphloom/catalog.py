"""All queries of the library with their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import base, canon, documents, knowledge, stores, whole


LOADED = (canon, documents, knowledge, stores, whole)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.d6(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
