"""Named queries: a Spark builder and, where SQL can say it, the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracemark.plans.oracle_views import with_views
from tracemark.sources.views import Tables


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register the decorated `Tables -> DataFrame` function under `name`."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, with_views(sql, views) if sql else None)
        return build

    return add


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name].build

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(spark, folder))

    return run
