"""Numeric scalar functions and aggregates that pass over missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_finite


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column) -> Column:
    """x rounded to a whole number, halves to even."""
    return F.rint(x)


def or_missing(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(is_finite(x), x)


def nan_mean(x: Column) -> Column:
    return F.avg(or_missing(x))


def nan_median(x: Column) -> Column:
    return F.percentile(or_missing(x), F.lit(0.5))


def nan_argmin(key: Column, x: Column) -> Column:
    """The key of the least finite x, the least key of ties."""
    return F.min_by(key, F.when(is_finite(x), F.struct(x.alias("x"), key.alias("key"))))


def worst_if_missing(x: Column) -> Column:
    """x, positive infinity where it is null, NaN or infinite."""
    return F.when(is_finite(x), x).otherwise(float("inf"))


def norm(values: Column, p: float = 2.0) -> Column:
    """p-norm of an array."""
    return F.pow(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))
