"""Ready queries over the test tables, each with the SQL that must give the same rows.

The test tables are no audit evidence, so every query first derives its evidence from whole
tables by simple rules; the SQL derives the same evidence on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Catalog:
    """Queries by name, with SQL where it can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if query.__name__ in self.queries:
                raise ValueError(f"{query.__name__} is registered twice")
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return register


CATALOG = Catalog()


def load() -> Catalog:
    from assayworks.catalog import (  # noqa: F401  (each module registers its queries)
        access, assured, exposure, jobs, learning, reports, scans, settings, tables, texts)

    return CATALOG
