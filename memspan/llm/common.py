"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a batch sent to Python: a batch of long texts must fit in a worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small enough for documents of any length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` agrees on texts of ASCII only and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, whatever the optimizer does to aliases.

    An alias may be replaced by its expression inside a lambda, and then be computed for
    each element; a lambda's variable never is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))
