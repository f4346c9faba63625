"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: str | Column, digits: int = 4) -> Column:
    """Rounded half up, without a negative zero: sums of doubles come in any order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def nearest(c: str | Column, digits: int = 4) -> Column:
    """`rounded` by double arithmetic alone, as DuckDB does it: for results of very many rows, where `round` makes two decimals of each."""
    c, scale = F.col(c) if isinstance(c, str) else c, 10.0**digits
    x, r = c * scale, F.rint(c * scale)
    whole = r + F.when((x > 0) & (x - r == 0.5), 1.0).when((x < 0) & (x - r == -0.5), -1.0).otherwise(0.0)
    return F.when(F.abs(x) < 2.0**52, whole / scale).otherwise(c) + F.lit(0.0)  # greater ones have no such digits


def exact_money(c: str | Column) -> Column:
    """A double of cents as DECIMAL(12,2), so that sums don't depend on order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def hour_index(ts: str | Column, start: str) -> Column:
    """Whole hours since `start` (UTC), from 0."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), c.cast("timestamp_ntz"))
