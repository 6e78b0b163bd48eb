"""Single-row tables as column values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct column of another query (a scalar subquery)."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()
