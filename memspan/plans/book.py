"""A book of queries: each name has a function of the lens, and SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.plans.lens import Lens

Query = Callable[[Lens], DataFrame]


class Book(dict):
    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query; without SQL only its rows are compared."""

        def put(f: Query) -> Query:
            self[name] = (f, sql)
            return f

        return put


def r6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)
