"""How a plan is registered: a function of the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silexa.sources.tables import CTES, Tables

Plan = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, model: bool = True) -> Callable[[Plan], Plan]:
        """``sql`` may use the derived tables when ``model`` is set."""

        def register(plan: Plan) -> Plan:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plan(Tables(spark, sf_dir))

            query.__doc__ = plan.__doc__
            self.queries[plan.__name__] = query
            if sql:
                self.sql[plan.__name__] = f"WITH RECURSIVE {CTES}\n{sql}" if model else sql
            return plan

        return register
