"""Percentiles as four different reports define them; each is kept, none is unified with another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sorted(c: Column) -> Column:
    return F.array_sort(F.collect_list(c))


def median(c: Column) -> Column:
    """The middle value, or the mean of the middle two."""
    return F.percentile(c, F.lit(0.5))


def at_floor(c: Column, p: float) -> Column:
    """The value at floor(p * (n - 1)) of the sorted values."""
    s = _sorted(c)
    return F.get(s, F.floor(F.lit(p) * (F.size(s) - 1)).cast("int"))


def at_share(c: Column, p: float) -> Column:
    """The value at min(n - 1, floor(p * n))."""
    s = _sorted(c)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.lit(p) * F.size(s)).cast("int")))


def interpolated(c: Column, p: float) -> Column:
    """Inclusive linear interpolation."""
    return F.percentile(c, F.lit(p))
