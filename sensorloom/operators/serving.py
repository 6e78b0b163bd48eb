"""Read-side operators: filters, pages, top lists and replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def serve_filtered(
    df: DataFrame,
    city: str | None = None,
    sensors: Sequence | None = None,
    start: str | None = None,
    end: str | None = None,
    flag: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Optional predicates; each one is a plain filter that reaches the scan."""
    if city is not None:
        df = df.where(F.lower("city") == city.lower())
    if sensors is not None:
        df = df.where(F.col("sensor_id").isin(*sensors))
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    if flag is not None:
        df = df.where(F.col("overall_quality_flag") == flag)
    return df


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame, keys: Sequence[str], n: int, *order: Column, salts: int = 64
) -> DataFrame:
    """First n rows per group.

    Each group is first cut to n rows per salt, so that a group with a large
    share of the rows is sorted by many tasks; the final sort sees at most
    ``salts * n`` rows of a group.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        cut.where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
        .withColumn("rank", rank)
        .where(F.col("rank") <= n)
    )


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """Total number of rows and one ordered page of them."""
    return df.count(), df.orderBy(*order).offset(offset).limit(limit)


def observation_stream(predictions: DataFrame) -> DataFrame:
    """One event per timestamp and sensor."""
    return predictions.select("ts", "sensor_id", "city").distinct()


def forecast_lookup_replay(predictions: DataFrame, choice: dict[str, str]) -> DataFrame:
    """Per reading and horizon, the configured model's stored prediction.

    A conditional aggregate over the archive finds present and missing
    predictions in one shuffle, without joining the readings to the archive.
    """
    keys = ["ts", "sensor_id"]
    picked = predictions.groupBy(*keys).agg(
        *[
            F.max(
                F.when((F.col("horizon") == h) & (F.col("model") == m), F.col("predicted"))
            ).alias(f"_p_{h}")
            for h, m in choice.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(f"_p_{h}").alias("predicted")
            )
            for h, m in choice.items()
        ]
    )
    return picked.select(*keys, F.explode(rows).alias("_r")).select(
        *keys,
        "_r.*",
        F.when(F.col("_r.predicted").isNull(), "missing").otherwise("ok").alias("status"),
    )


def tail_context(
    history: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str, k: int
) -> DataFrame:
    """Last k history rows per key in front of the rows, later source wins on a clash."""
    tail = top_per_group(history, keys, k, F.col(ts).desc()).drop("rank")
    both = tail.withColumn("_p", F.lit(0)).unionByName(rows.withColumn("_p", F.lit(1)))
    rest = [c for c in rows.columns if c not in (*keys, ts)]
    best = both.groupBy(*keys, ts).agg(
        F.max_by(F.struct(*rest), "_p").alias("_r"), F.max("_p").alias("_p")
    )
    return best.select(*keys, ts, "_r.*", (F.col("_p") == 0).alias("is_context"))
