"""Scores, ages, sets and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def age_days(now_s: Column, then_s: Column) -> Column:
    """Whole seconds since ``then_s``, not below zero, in days; an unknown time has age 0."""
    return F.coalesce(F.greatest(F.lit(0), now_s - then_s), F.lit(0)) / F.lit(float(DAY))


def recency_access(base: Column, age: Column, retrievals: Column) -> Column:
    """``base`` decayed over 30 days and lifted by up to 20 retrievals."""
    return base * F.exp(-age / 30.0) * (1.0 + 0.1 * F.least(F.greatest(retrievals, F.lit(0)), F.lit(20)))


def strengthened(strength: Column, times: Column | None = None) -> Column:
    """15 % stronger, as often as told, 1 at most."""
    return F.least(strength * (F.lit(1.15) if times is None else F.pow(F.lit(1.15), times)), F.lit(1.0))


def decayed(strength: Column, age: Column, period: int) -> Column:
    """A tenth less for each whole period, 0.1 at least; nothing changes up to the first period's last day."""
    days = F.floor(age)
    periods = F.floor(days / period)
    return F.when(days > period, F.greatest(F.lit(0.1), strength * F.pow(F.lit(0.9), periods))).otherwise(strength)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; two empty sets have none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def long_words(text: Column) -> Column:
    """Distinct lower-cased words of more than two bytes."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.octet_length(w) > 2))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    double = lambda x: x.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def token_estimate(line: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(line) / 4).cast("long")
