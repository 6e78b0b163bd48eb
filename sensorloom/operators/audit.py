"""Completeness, sampling, duplicate and numeric audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, finite
from sensorloom.operators.series import MINUTE, Series, islands, to_long, with_previous
from sensorloom.sources.staging import stage

SECOND = 1_000_000


def channel_availability(df: DataFrame, s: Series, channels: Sequence[str]) -> DataFrame:
    """Per key and channel: rows, present values, availability status."""
    wide = df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("readings"), *[F.count(c).alias(c) for c in channels]
    )
    return wide.unpivot([*s.keys, "readings"], list(channels), "channel", "present").withColumn(
        "status",
        F.when(F.col("present") == 0, "STRUCTURALLY_UNAVAILABLE")
        .when(F.col("present") < F.col("readings"), "PARTIALLY_MISSING")
        .otherwise("AVAILABLE"),
    )


def provided_channels(df: DataFrame, s: Series, channels: Sequence[str]) -> DataFrame:
    """Keys and the channels they report at all."""
    return (
        channel_availability(df, s, channels)
        .where(F.col("present") > 0)
        .select(*s.keys, "channel")
    )


def provided_long(
    df: DataFrame, s: Series, channels: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    """Long channel table without structurally absent channels."""
    long = to_long(df, ids, channels)
    # Staged, so that its size decides whether the long table has to be shuffled.
    provided = stage(provided_channels(df, s, channels))
    return long.join(provided, [*s.keys, "channel"], "left_semi")


def intervals(df: DataFrame, s: Series) -> DataFrame:
    """Time between consecutive distinct timestamps of a key, in milliseconds."""
    stamps = df.select(*s.keys, s.ts).distinct()
    plain = Series(keys=s.keys, ts=s.ts, block_hours=s.block_hours)
    return (
        with_previous(stamps, plain, [])
        .where(F.col("_prev").isNotNull())
        .select(
            *s.keys,
            F.col("_prev")["_us"].alias("from_us"),
            F.col("_us").alias("to_us"),
            ((F.col("_us") - F.col("_prev")["_us"]) / SECOND).alias("seconds"),
        )
    )


def interval_histogram(df: DataFrame, s: Series) -> DataFrame:
    return (
        intervals(df, s)
        .groupBy(*s.keys, (F.round("seconds", 3) / 60).alias("minutes"))
        .agg(F.count(F.lit(1)).alias("readings"))
    )


def _expected(steps: DataFrame, s: Series) -> DataFrame:
    """Mode (smallest on ties) of the interval, else its median, per key."""
    counts = steps.groupBy(*s.keys, F.round("seconds", 3).alias("_s")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    mode = counts.groupBy(*s.keys).agg(
        F.max_by("_s", F.struct(F.col("_c"), -F.col("_s"))).alias("mode_seconds")
    )
    median = exact_quantiles(steps, s.keys, "seconds", {"median_seconds": 0.5})
    return median.join(mode, list(s.keys)).withColumn(
        "expected_seconds",
        F.when(F.col("mode_seconds") > 0, F.col("mode_seconds")).otherwise(
            F.col("median_seconds")
        ),
    )


def gap_severity(missing: Column, seconds: Column, expected: Column) -> Column:
    per_day = F.floor(F.lit(24 * 3600) / expected)
    return (
        F.when(missing <= 0, "NORMAL")
        .when(missing == 1, "MINOR")
        .when(missing <= 4, "MODERATE")
        .when((seconds < 24 * 3600) & (missing < F.greatest(F.lit(96), per_day)), "MAJOR")
        .otherwise("CRITICAL")
    )


def gap_events(df: DataFrame, s: Series) -> DataFrame:
    """Intervals longer than 1.5 times the expected cadence of their key."""
    return _gaps(stage(intervals(df, s)), s)


def _gaps(steps: DataFrame, s: Series) -> DataFrame:
    found = steps.join(_expected(steps, s), list(s.keys)).where(
        F.col("seconds") > F.col("expected_seconds") * 1.5
    )
    missing = F.greatest(
        F.lit(0).cast("long"),
        F.bround(F.col("seconds") / F.col("expected_seconds")).cast("long") - 1,
    )
    return found.select(
        *s.keys,
        F.timestamp_micros("from_us").cast("timestamp_ntz").alias("gap_start"),
        F.timestamp_micros("to_us").cast("timestamp_ntz").alias("gap_end"),
        F.col("seconds").alias("duration_seconds"),
        (F.col("seconds") / 3600).alias("duration_hours"),
        missing.alias("missing_readings"),
        gap_severity(missing, F.col("seconds"), F.col("expected_seconds")).alias("severity"),
    )


def sampling_profile(df: DataFrame, s: Series) -> DataFrame:
    """Interval statistics, expected cadence and gap counts per key."""
    steps = stage(intervals(df, s))
    span = steps.groupBy(*s.keys).agg(
        F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds")
    )
    gaps = _gaps(steps, s).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.sum("missing_readings").alias("missing_readings"),
        F.count_if(F.col("severity").isin("MAJOR", "CRITICAL")).alias("major_gap_count"),
        F.max("duration_hours").alias("longest_gap_hours"),
    )
    return (
        _expected(steps, s)
        .join(span, list(s.keys))
        .join(gaps, list(s.keys), "left")
        .withColumn("expected_minutes", F.col("expected_seconds") / 60)
        .drop("expected_seconds")
        .na.fill(0, ["gap_count", "missing_readings", "major_gap_count"])
        .na.fill(0.0, ["longest_gap_hours"])
    )


def missing_runs(long: DataFrame, s: Series) -> DataFrame:
    """Maximal runs of null values per key and channel."""
    by = s.by("channel")
    flagged = long.withColumn("_null", F.col("value").isNull())
    runs = islands(flagged, by, ["_null"], lambda p, c: p["_null"] != c["_null"], "run")
    return (
        runs.where("_null")
        .groupBy(*by.keys, "run")
        .agg(
            F.min(s.ts).alias("start_time"),
            F.max(s.ts).alias("end_time"),
            F.count(F.lit(1)).alias("readings"),
        )
        .drop("run")
    )


def gap_periods(gaps: DataFrame, provided: DataFrame, s: Series) -> DataFrame:
    """Gaps as missing periods of every channel their key provides."""
    return gaps.join(provided, list(s.keys)).select(
        *s.keys,
        "channel",
        F.col("gap_start").alias("start_time"),
        F.col("gap_end").alias("end_time"),
        F.col("missing_readings").alias("readings"),
        F.lit("TIME_GAP").alias("classification"),
    )


def missing_summary(long: DataFrame, s: Series) -> DataFrame:
    """Missing count, share, longest run and class per key and channel."""
    by = [*s.keys, "channel"]
    counts = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("value").isNull()).alias("missing_count"),
    )
    longest = missing_runs(long, s).groupBy(*by).agg(F.max("readings").alias("longest_run"))
    joined = counts.join(longest, by, "left").na.fill(0, ["longest_run"])
    return joined.select(
        *by,
        "missing_count",
        (100 * F.col("missing_count") / F.col("readings")).alias("missing_percentage"),
        "longest_run",
        F.when(F.col("missing_count") == F.col("readings"), "STRUCTURALLY_UNAVAILABLE")
        .when((F.col("missing_count") > 0) & (F.col("longest_run") == 1), "RANDOM_MISSING")
        .when(F.col("missing_count") > 0, "UNKNOWN_MISSING")
        .otherwise("NONE")
        .alias("classification"),
    )


def missing_by(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null count and share of each column, per group (or for the whole table)."""
    wide = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return wide.unpivot([*groups, "_n"], list(columns), "channel", "missing_count").select(
        *groups,
        "channel",
        "missing_count",
        (100 * F.col("missing_count") / F.col("_n")).alias("missing_percentage"),
    )


def duplicate_audit(df: DataFrame, s: Series, channels: Sequence[str]) -> DataFrame:
    """One row of duplicate counts; every count is a grouped aggregate."""

    def extra(columns: Sequence[str], prefix: str) -> DataFrame:
        sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
        repeated = F.when(F.col("_c") > 1, F.col("_c"))
        return sizes.agg(
            F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias(f"{prefix}_surplus"),
            F.coalesce(F.sum(repeated), F.lit(0)).alias(f"{prefix}_rows"),
            F.count(repeated).alias(f"{prefix}_groups"),
        )

    full = extra(df.columns, "full").select(
        F.col("full_surplus").alias("full_duplicate_rows"),
        F.col("full_rows").alias("full_duplicate_rows_in_groups"),
    )
    stamp = extra([s.ts], "ts").select(F.col("ts_groups").alias("shared_timestamps"))
    key = extra([*s.keys, s.ts], "key").select(
        F.col("key_rows").alias("duplicate_timestamp_rows"),
        F.col("key_groups").alias("duplicate_timestamp_groups"),
    )
    repeated = extra([*s.keys, s.ts, *channels], "m").select(
        F.col("m_rows").alias("repeated_record_rows")
    )
    # Four single rows side by side.
    parts = [p.withColumn("_one", F.lit(1)) for p in (full, stamp, key, repeated)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "_one")
    return out.drop("_one")


def numeric_audit(long: DataFrame) -> DataFrame:
    """Counts and finite-value statistics per channel."""
    value = F.col("value")
    good = finite(value)
    basic = long.groupBy("channel").agg(
        F.count(value).alias("count"),
        F.count_if(value.isNull()).alias("missing"),
        F.count_if(F.abs(value) == float("inf")).alias("infinite"),
        F.count_if(value == 0).alias("zero_count"),
        F.count_if(value < 0).alias("negative_count"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.avg(good).alias("mean"),
        F.stddev_samp(good).alias("std"),
    )
    tails = exact_quantiles(long, ["channel"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return basic.join(tails, "channel", "left")


def overview(df: DataFrame, s: Series, channels: Sequence[str]) -> DataFrame:
    """Table-level counts, time range and missing share in one pass."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in channels), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("city").alias("city_count"),
        F.count_distinct(*s.keys).alias("sensor_count"),
        F.min(s.ts).alias("earliest"),
        F.max(s.ts).alias("latest"),
        missing.alias("missing_cells"),
        (100 * missing / (F.count(F.lit(1)) * len(channels))).alias("missing_percentage"),
    ).withColumn(
        "duration_hours",
        (F.unix_micros(F.col("latest").cast("timestamp"))
         - F.unix_micros(F.col("earliest").cast("timestamp"))) / (60 * MINUTE),
    )


def sensors_per_city(df: DataFrame, s: Series) -> DataFrame:
    """Sensor list of each city; sensors are de-duplicated before collecting."""
    return (
        df.select("city", *s.keys)
        .distinct()
        .groupBy("city")
        .agg(F.sort_array(F.collect_list(s.keys[0])).alias("sensors"))
    )


def availability_audit(df: DataFrame, s: Series) -> DataFrame:
    """Expected grid readings, missing stamps and received share per key.

    Every reading sits on the grid or not, so the grid need not be built: the
    expected count follows from the span.
    """
    width = s.cadence_minutes * MINUTE
    steps = intervals(df, s)
    stamps = df.select(*s.keys, s.ts).distinct()
    us = F.unix_micros(F.col(s.ts).cast("timestamp"))
    counts = stamps.groupBy(*s.keys).agg(
        F.min(us).alias("_a"),
        F.max(us).alias("_b"),
        F.count(F.lit(1)).alias("received_readings"),
    )
    on_grid = stamps.join(counts.select(*s.keys, "_a"), list(s.keys)).groupBy(*s.keys).agg(
        F.count_if(F.pmod(us - F.col("_a"), F.lit(width)) == 0).alias("_hits")
    )
    tolerance = s.cadence_minutes * 60 * 1.5
    gaps = steps.groupBy(*s.keys).agg(
        (F.max("seconds") / 60).alias("largest_gap_minutes"),
        F.count_if(F.col("seconds") > tolerance).alias("gaps_over_tolerance"),
        F.count_if(F.col("seconds") >= s.gap_minutes * 60).alias("major_gaps"),
    )
    expected = F.floor((F.col("_b") - F.col("_a")) / width) + 1
    return (
        counts.join(on_grid, list(s.keys))
        .join(gaps, list(s.keys), "left")
        .select(
            *s.keys,
            expected.alias("expected_readings"),
            "received_readings",
            (expected - F.col("_hits")).alias("missing_timestamps"),
            F.round(100 * F.col("received_readings") / expected, 3).alias("received_percent"),
            F.coalesce("largest_gap_minutes", F.lit(0.0)).alias("largest_gap_minutes"),
            F.coalesce("gaps_over_tolerance", F.lit(0)).alias("gaps_over_tolerance"),
            F.coalesce("major_gaps", F.lit(0)).alias("major_gaps"),
        )
    )
