"""Event detectors and row flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, finite, robust_scale
from sensorloom.operators.moving import moving_statistics
from sensorloom.operators.series import (
    MINUTE, Series, bucket_index, frame_window, home_rows, islands, micros, row_halo,
    with_ordinal, with_previous,
)
from sensorloom.sources.staging import stage

# Normal-consistency factors of the median absolute deviation.
MAD_NORMAL = 1.482602218505602
MAD_ROUNDED = 1.4826

# Broad physical bounds per channel (low, high).
BOUNDS: dict[str, tuple[float, float | None]] = {
    "pm25": (0.0, None),
    "temperature": (-50.0, 70.0),
    "humidity": (0.0, 100.0),
    "no2": (0.0, None),
    "o3": (0.0, None),
    "aqi": (0.0, None),
}
ZERO_SUSPECT = ["pm25", "no2", "o3"]


def by_channel(table: dict[str, float | None], channel: Column) -> Column:
    """Look a channel up in a small fixed table."""
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(channel == name, F.lit(value).cast("double")).otherwise(out)
    return out


def plausibility_flags(long: DataFrame, s: Series) -> DataFrame:
    """Ordered plausibility rules; rows without a finding have a null flag."""
    by = [*s.keys, "channel"]
    fences = exact_quantiles(long, by, "value", {"_q1": 0.25, "_q3": 0.75})
    joined = long.join(fences, by, "left")
    value, iqr = F.col("value"), F.col("_q3") - F.col("_q1")
    low = by_channel({c: b[0] for c, b in BOUNDS.items()}, F.col("channel"))
    high = by_channel({c: b[1] for c, b in BOUNDS.items()}, F.col("channel"))
    flag = (
        F.when(value.isNull() | F.isnan(value), "MISSING")
        .when(F.abs(value) == float("inf"), "POSSIBLE_SENSOR_ERROR")
        .when((value < low) | F.coalesce(value > high, F.lit(False)), "POSSIBLE_SENSOR_ERROR")
        .when((iqr > 0) & (value > F.col("_q3") + 4 * iqr), "EXTREME")
        .when((value == 0) & F.col("channel").isin(*ZERO_SUSPECT), "SUSPICIOUS")
    )
    return joined.withColumn("flag", flag).drop("_q1", "_q3")


def jump_events(long: DataFrame, s: Series, minimum: int = 12) -> DataFrame:
    """Row-to-row changes beyond both the MAD and the IQR fence of their series."""
    by = s.by("channel")
    steps = stage(
        with_previous(long, by, ["value"]).select(
            *long.columns,
            F.col("_prev")["value"].alias("previous_value"),
            F.abs(F.col("value") - F.col("_prev")["value"]).alias("absolute_change"),
            ((F.col("_us") - F.col("_prev")["_us"]) / (60 * MINUTE)).alias("_hours"),
        )
    )
    keys = list(by.keys)
    scale = robust_scale(steps, keys, "absolute_change", MAD_NORMAL)
    sizes = steps.groupBy(*keys).agg(F.count("absolute_change").alias("_n"))
    threshold = F.greatest(
        F.col("median") + 8 * F.col("mad"), F.col("q3") + 3 * F.col("iqr"), F.lit(1e-12)
    )
    fences = stage(
        scale.join(sizes, keys)
        .where(F.col("_n") >= minimum)
        .select(*keys, threshold.alias("robust_threshold"))
    )
    change = F.col("absolute_change")
    return (
        steps.join(fences, keys)
        .where(change >= F.col("robust_threshold"))
        .select(
            *long.columns,
            "previous_value",
            "absolute_change",
            F.when(F.col("previous_value") != 0, F.abs(change / F.col("previous_value"))).alias(
                "relative_change"
            ),
            F.when(F.col("_hours") > 0, change / F.col("_hours")).alias("rate_per_hour"),
            "robust_threshold",
            (change / F.col("robust_threshold")).alias("robust_strength"),
        )
    )


def _run_table(runs: DataFrame, keys: Sequence[str], s: Series, *extra: Column) -> DataFrame:
    grouped = runs.groupBy(*keys, "run").agg(
        F.min(s.ts).alias("start_time"),
        F.max(s.ts).alias("end_time"),
        F.count(F.lit(1)).alias("readings"),
        *extra,
    )
    hours = (micros("end_time") - micros("start_time")) / (60 * MINUTE)
    return grouped.withColumn("duration_hours", hours)


def flatline_runs(long: DataFrame, s: Series, minimum: int | None = None) -> DataFrame:
    """Runs of one repeated value; nulls end a run, gaps do not."""
    minimum = minimum or max(8, round(120 / s.cadence_minutes))
    by = s.by("channel")

    def changed(prev: Column, cur: Column) -> Column:
        return cur["value"].isNull() | prev["value"].isNull() | (prev["value"] != cur["value"])

    runs = islands(long, by, ["value"], changed, "run").where(F.col("value").isNotNull())
    return (
        _run_table(runs, by.keys, s, F.max("value").alias("value"))
        .where(F.col("readings") >= minimum)
        .drop("run")
    )


def low_variance_runs(
    long: DataFrame, s: Series, k: int, iqr_share: float = 0.001, floor: float = 1e-6
) -> DataFrame:
    """Runs of at least ``2 k`` rows whose k-row deviation stays within tolerance."""
    by = s.by("channel")
    keys = list(by.keys)
    spread = row_halo(with_ordinal(long, by), by, back=k - 1)
    w = frame_window(by, order="_ord").rowsBetween(-(k - 1), 0)
    rolled = home_rows(
        spread.withColumn("_std", F.stddev_samp("value").over(w)).withColumn(
            "_count", F.count("value").over(w)
        )
    )
    tolerance = exact_quantiles(long, keys, "value", {"_q1": 0.25, "_q3": 0.75}).select(
        *keys,
        F.greatest((F.col("_q3") - F.col("_q1")) * iqr_share, F.lit(floor)).alias("_tol"),
    )
    near = F.coalesce((F.col("_count") == k) & (F.col("_std") <= F.col("_tol")), F.lit(False))
    flagged = rolled.drop("_us", "_blk").join(tolerance, keys).withColumn("_near", near)
    runs = islands(flagged, by, ["_near"], lambda p, c: p["_near"] != c["_near"], "run")
    return _run_table(runs.where("_near"), keys, s).where(F.col("readings") >= 2 * k).drop("run")


def drift_runs(
    long: DataFrame,
    s: Series,
    short_minutes: int = 1440,
    baseline_minutes: int = 10080,
    short_minimum: int = 48,
    baseline_minimum: int = 192,
    run_minimum: int = 24,
) -> DataFrame:
    """Runs where the short rolling median leaves the long one by 3 robust scales."""
    by = s.by("channel")
    keys = list(by.keys)
    present = long.where(F.col("value").isNotNull())
    spans = {"short": (short_minutes, short_minimum), "base": (baseline_minutes, baseline_minimum)}
    wanted = {f"_{n}_{stat}": ("value", m, stat) for n, (m, _) in spans.items() for stat in ("median", "count")}
    rolled = moving_statistics(present, by, wanted)

    def median(name: str) -> Column:
        return F.when(F.col(f"_{name}_count") >= spans[name][1], F.col(f"_{name}_median"))

    # Sliding medians are the costly part and are read by five passes below.
    delta = stage(rolled.withColumn("delta", median("short") - median("base")).drop("_us", *wanted))
    scale = robust_scale(delta, keys, "delta", MAD_NORMAL)
    sizes = delta.groupBy(*keys).agg(
        F.count("delta").alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    limits = stage(
        scale.join(sizes, keys)
        .where(
            (F.col("_rows") >= baseline_minimum)
            & (F.col("_n") >= short_minimum)
            & (F.col("mad") > 0)
        )
        .select(*keys, (3 * F.col("mad")).alias("_limit"))
    )
    flagged = delta.join(limits, keys).withColumn(
        "_out", F.coalesce(F.abs("delta") > F.col("_limit"), F.lit(False))
    )
    runs = stage(
        islands(flagged, by, ["_out"], lambda p, c: p["_out"] != c["_out"], "run")
        .where("_out")
        .select(*keys, "run", s.ts, "delta")
    )
    table = _run_table(runs, keys, s).where(F.col("readings") >= run_minimum)
    magnitude = exact_quantiles(runs, [*keys, "run"], "delta", {"magnitude": 0.5})
    return table.join(magnitude, [*keys, "run"]).drop("run")


def flag_by_interval(
    df: DataFrame, events: DataFrame, s: Series, out: str, bucket_hours: int = 24
) -> DataFrame:
    """Flag rows that fall inside any ``[start_time, end_time]`` of their key.

    Intervals are spread over the time buckets they touch, so the join is an
    equi join on key and bucket instead of a range join.
    """
    size = bucket_hours * 60 * MINUTE
    spans = events.select(
        *s.keys,
        micros("start_time").alias("_a"),
        micros("end_time").alias("_b"),
        F.explode(
            F.sequence(
                bucket_index(micros("start_time"), size), bucket_index(micros("end_time"), size)
            )
        ).alias("_bucket"),
    ).distinct()
    rows = df.withColumn("_us", micros(s.ts)).withColumn("_bucket", bucket_index(F.col("_us"), size))
    stamps = rows.select(*s.keys, "_bucket", "_us").distinct()
    hit = stamps.join(spans, [*s.keys, "_bucket"]).where(
        F.col("_us").between(F.col("_a"), F.col("_b"))
    )
    hits = hit.select(*s.keys, "_us").distinct().withColumn(out, F.lit(True))
    return (
        rows.join(hits, [*s.keys, "_us"], "left")
        .withColumn(out, F.coalesce(out, F.lit(False)))
        .drop("_us", "_bucket")
    )


def flag_by_key(df: DataFrame, events: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """Flag rows whose key columns occur among the events."""
    hits = events.select(*on).distinct().withColumn(out, F.lit(True))
    return df.join(hits, list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def overall_quality_flag() -> Column:
    """First matching label over the row flags."""
    return (
        F.when(F.col("suspicious_value_flag") | F.col("jump_flag"), "SUSPICIOUS")
        .when(F.col("flatline_flag"), "POSSIBLE_STUCK_PATTERN")
        .when(F.col("possible_drift_flag"), "POSSIBLE_DRIFT")
        .when(F.col("sampling_gap_flag"), "GAP")
        .when(F.col("missing_flag"), "MISSING_OR_UNAVAILABLE")
        .otherwise("NORMAL")
    )


def flag_rows(
    df: DataFrame,
    s: Series,
    long: DataFrame,
    gaps: DataFrame,
    jumps: DataFrame,
    flatlines: DataFrame,
    drifts: DataFrame,
) -> DataFrame:
    """Observations plus the six flags and the priority label.

    ``long`` holds provided channels only, so structural absence is not missing.
    """
    key = [*s.keys, s.ts]
    values = (
        plausibility_flags(long, s)
        .groupBy(*key)
        .agg(
            F.bool_or(F.coalesce(F.col("flag") == "MISSING", F.lit(False))).alias("missing_flag"),
            F.bool_or(F.coalesce(F.col("flag") != "MISSING", F.lit(False))).alias(
                "suspicious_value_flag"
            ),
        )
    )
    ends = gaps.select(*s.keys, F.col("gap_end").alias(s.ts))
    out = df.join(values, key, "left").na.fill(False, ["missing_flag", "suspicious_value_flag"])
    out = flag_by_key(out, ends, key, "sampling_gap_flag")
    out = flag_by_key(out, jumps, key, "jump_flag")
    out = flag_by_interval(out, flatlines, s, "flatline_flag")
    out = flag_by_interval(out, drifts, s, "possible_drift_flag")
    return out.withColumn("overall_quality_flag", overall_quality_flag())


def sensor_quality_summary(
    df: DataFrame,
    s: Series,
    long: DataFrame,
    sampling: DataFrame,
    flatlines: DataFrame,
    jumps: DataFrame,
    drifts: DataFrame,
) -> DataFrame:
    """Missing rate over provided channels, event counts, statuses, explanation."""
    keys = list(s.keys)

    def counted(events: DataFrame, name: str) -> DataFrame:
        return events.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    missing = long.groupBy(*keys).agg(
        (100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing_rate")
    )
    out = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("readings"))
        .join(missing, keys, "left")
        .join(sampling.select(*keys, "longest_gap_hours", "gap_count"), keys, "left")
        .join(counted(flatlines, "flatline_events"), keys, "left")
        .join(counted(jumps, "jump_count"), keys, "left")
        .join(counted(drifts, "drift_periods"), keys, "left")
        .na.fill(0)
        .na.fill(0.0, ["missing_rate", "longest_gap_hours"])
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("longest_gap_hours") >= 24, F.lit("Poor Availability")),
            F.when(F.col("drift_periods") > 0, F.lit("Possible Drift")),
            F.when(F.col("flatline_events") > 0, F.lit("Possible Stuck Pattern")),
        )
    )
    calm = F.when((F.col("jump_count") > 0) | (F.col("missing_rate") > 1), "Needs Review").otherwise(
        "Healthy-looking"
    )
    reasons = F.concat_ws(
        " ",
        F.when(
            F.col("longest_gap_hours") >= 24,
            F.format_string("gap of %.1f h", "longest_gap_hours"),
        ),
        F.when(
            F.col("drift_periods") > 0,
            F.format_string("drift runs: %d", "drift_periods"),
        ),
        F.when(
            F.col("flatline_events") > 0,
            F.format_string("flat runs: %d", "flatline_events"),
        ),
        F.when(
            F.col("jump_count") > 0, F.format_string("jumps: %d", "jump_count")
        ),
    )
    return out.withColumn(
        "statuses", F.when(F.size(found) > 0, found).otherwise(F.array(calm))
    ).withColumn(
        "explanation", F.when(reasons != "", reasons).otherwise("nothing found")
    )
