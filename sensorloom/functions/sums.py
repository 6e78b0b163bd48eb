"""Sums of doubles that do not depend on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiples of 1 / _GRID add up without rounding while the total stays below 2**53 / _GRID.
_GRID = 1024.0


def steady_sum(value: Column) -> Column:
    """The sum, rounded about once instead of at every row.

    Each value is split without loss into a multiple of 1/1024 and a rest below it.  The multiples add
    up exactly, and the rounding of the small rests does not reach the last place of the total.
    """
    coarse = F.when(F.abs(value) < 2.0**53 / _GRID, F.rint(value * _GRID) / _GRID).otherwise(value)
    return F.sum(coarse) + F.sum(value - coarse)


def steady_mean(value: Column) -> Column:
    """The mean from a steady sum; null without values."""
    return F.try_divide(steady_sum(value), F.count(value))
