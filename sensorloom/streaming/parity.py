"""Live features against batch features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_parity_check(
    live: DataFrame, batch: DataFrame, keys: Sequence[str], features: Sequence[str],
    tolerance: float = 1e-8,
) -> DataFrame:
    """Per feature: compared rows, failures and the largest difference.

    Two nulls agree; a null against a value, or a row missing on one side, fails.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
            list(keys), list(features), "feature", name
        )
        return long.withColumn(f"_{name}", F.lit(True))

    on = [*keys, "feature"]
    both = side(live, "live").join(side(batch, "batch"), on, "full_outer")
    difference = F.abs(F.col("live") - F.col("batch"))
    same = F.coalesce("_live", F.lit(False)) & F.coalesce("_batch", F.lit(False)) & (
        (F.col("live").isNull() & F.col("batch").isNull())
        | F.coalesce(difference <= tolerance, F.lit(False))
    )
    return both.groupBy("feature").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~same).alias("failures"),
        (F.coalesce(F.max(difference), F.lit(0.0)) <= tolerance).alias("within_tolerance"),
    )


def causality_check(
    full: DataFrame, cut: DataFrame, keys: Sequence[str], features: Sequence[str],
    tolerance: float = 1e-8,
) -> DataFrame:
    """Features computed without the future must equal those computed with it."""
    known = full.join(cut.select(*keys), list(keys), "left_semi")
    return feature_parity_check(cut, known, keys, features, tolerance)
