"""Statistics of short arrays (bounded windows), inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array without nulls; null when empty."""

    def at(n: Column) -> Column:
        position = (n - 1) * p
        low = F.floor(position)

        def value(i: Column) -> Column:
            return F.get(ordered, i.cast("int"))

        return value(low) + (value(F.ceil(position)) - value(low)) * (position - low)

    return let(F.size(ordered), at)


def median(values: Column) -> Column:
    return let(F.sort_array(values), lambda a: sorted_quantile(a, 0.5))


def scaled_mad(values: Column, factor: float) -> Column:
    return let(
        median(values),
        lambda m: factor * median(F.transform(values, lambda x: F.abs(x - m))),
    )


def quartiles(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(q1, q3)`` of the array."""
    return let(
        F.sort_array(values),
        lambda a: body(sorted_quantile(a, 0.25), sorted_quantile(a, 0.75)),
    )


def differences(values: Column) -> Column:
    """``x[i+1] - x[i]``; empty below two values."""
    later = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    earlier = F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: b - a)


def head(values: Column, drop_last: int) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - drop_last, F.lit(0)))


def tail(values: Column, count: int) -> Column:
    start = F.greatest(F.size(values) - count + 1, F.lit(1))
    return F.slice(values, start, F.lit(count))


def sign_changes(values: Column) -> Column:
    """Adjacent pairs of opposite sign."""
    later = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    products = F.zip_with(later, head(values, 1), lambda a, b: a * b)
    return F.size(F.filter(products, lambda x: x < 0))
