"""Registered queries: DataFrame plans and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL where SQL can express them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def registries() -> list[Registry]:
    from lotwise.plans import catalogue, identity, images, learning, market, parsing, pricing, rules, stream, textual, upkeep, valuation

    return [m.REGISTRY for m in (market, textual, parsing, catalogue, identity, learning, pricing, valuation, rules, upkeep, stream, images)]
