"""All queries of the core by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more
from .queries import ORACLE, QUERIES, corpus_merge


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | more.ORACLE


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The merged corpus."""
    return corpus_merge(spark, folder)
