"""Registration of queries over the archive views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnlake.sources.archive import VIEWS_SQL, Archive, from_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a function of an Archive; sql is a SELECT over the views, or further
    views (starting with a comma) and a SELECT."""

    def keep(build: Callable[[Archive], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(from_tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = (VIEWS_SQL if views else "") + sql
        return build

    return keep
