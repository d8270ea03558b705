"""Times as RFC-3339 texts, and days for people to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspan.functions.scores import age_days

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def seconds(text: Column) -> Column:
    """Seconds since 1970 of an RFC-3339 time; null for anything else."""
    return F.when(text.rlike(RFC3339), F.unix_seconds(F.upper(text).try_cast("timestamp")))


def age_of(text: Column, now_s: Column) -> Column:
    """Age in days of a time told as text; what is no time has age 0."""
    return age_days(now_s, seconds(text))


def month_day(at_s: Column) -> Column:
    """``Jun 01`` of a time in seconds, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at_s / 86_400).cast("int")), "MMM dd")
