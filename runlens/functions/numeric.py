"""Scalar helpers shared by all operators (finite values, safe ratios, rounding)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def missing(v: Column) -> Column:
    """True for null and NaN (a blank in a log and NaN mean the same)."""
    return v.isNull() | F.isnan(v)


def finite(v: Column) -> Column:
    """``v`` where it is a finite number, else null, so that Spark aggregates skip it."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(INF)), v)


def not_nan(v: Column) -> Column:
    """``v`` with NaN turned into null; infinities stay."""
    return F.when(~F.isnan(v), v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is zero or null."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def r6(v: Column, digits: int = 6) -> Column:
    return F.round(v, digits)


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def coerce_scalar(v: Column) -> Column:
    """Text of a JSON scalar to DOUBLE: booleans 1/0, numbers and numeric strings, else null."""
    low = F.lower(F.trim(v))
    return F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0)).otherwise(v.try_cast("double"))


def pct(x: Column, pattern: str) -> Column:
    return F.format_string(pattern, x)
