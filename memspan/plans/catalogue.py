"""The catalogue of named queries with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memspan.plans import base, graphs, life, more, searches, steps
from memspan.plans.lens import Lens, with_views

BOOKS = (base.BOOK, searches.BOOK, graphs.BOOK, life.BOOK, more.BOOK, steps.BOOK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Lens(spark, sf_dir))) for book in BOOKS for name, (f, _) in book.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for book in BOOKS for name, (_, sql) in book.items() if sql}
