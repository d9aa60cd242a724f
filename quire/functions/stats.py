"""Aggregates of page geometry (RFL-01, TXT-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_of(values: Column, p: float) -> Column:
    """The value at floor(p (n - 1) + 0.5) of an array in order, from 0: neither Spark's percentile nor its discrete one."""
    at = F.floor((F.size(values) - 1) * p + 0.5).cast("int")
    return F.get(F.array_sort(values), at)


def percentile(value: Column, p: float) -> Column:
    """percentile_of as an aggregate over a page's lines."""
    return percentile_of(F.collect_list(value), p)


def smallest_mode(value: Column, count: Column) -> Column:
    """Of counted values the most frequent one, of equally frequent ones the smallest."""
    return F.max_by(value, F.struct(count, -value))
