"""Names queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function (spark, sf_dir) -> DataFrame; without sql it has none."""

        def add(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return add
