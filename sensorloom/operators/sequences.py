"""Fixed-length feature sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.series import MINUTE, Series, frame_window, home_rows, time_halo


def sequence_windows(
    df: DataFrame, s: Series, columns: Sequence[str], length: int = 12
) -> DataFrame:
    """The last ``length`` feature rows where they are gap-free, per segment.

    A window is complete when its rows span exactly ``length - 1`` intervals, so
    only the rows of that span are needed and the look-back is bounded in time.
    """
    span = (length - 1) * s.cadence_minutes
    spread = time_halo(df, s, span)
    w = frame_window(s, "segment").rangeBetween(-span * MINUTE, 0)
    rows = spread.withColumn(
        "window", F.collect_list(F.struct(F.col("_us"), *columns)).over(w)
    )
    full = home_rows(rows).where(
        (F.size("window") == length)
        & (F.col("window")[0]["_us"] == F.col("_us") - span * MINUTE)
    )
    return full.withColumn(
        "window",
        F.transform("window", lambda x: F.struct(*[x[c].alias(c) for c in columns])),
    )
