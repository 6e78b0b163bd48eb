"""Averaged windows against health guidelines, targets and sample validity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.features import lag_label
from sensorloom.operators.series import (
    MINUTE, Series, frame_window, home_rows, left_open, shift_exact, time_halo, window_stat,
    with_next,
)

MEETS, ABOVE = "Meets WHO Guideline", "Above WHO Guideline"
INSUFFICIENT, ABSENT, UNIT = "Insufficient Data", "Not Available", "Unit Not Compatible"


@dataclass(frozen=True)
class Guideline:
    """One pollutant's guideline; ``cities`` limits where it is measured at all."""

    pollutant: str
    guideline: float
    hours: int = 24
    unit_compatible: bool = True
    cities: tuple[str, ...] | None = None
    targets: dict[str, float] = field(default_factory=dict)


# WHO 2021 short-term guidelines and interim targets.
WHO_2021 = [
    Guideline("pm25", 15.0, 24, targets={"IT-4": 25.0, "IT-3": 37.5, "IT-2": 50.0, "IT-1": 75.0}),
    Guideline("pm10", 45.0, 24, targets={"IT-4": 50.0, "IT-3": 75.0, "IT-2": 100.0, "IT-1": 150.0}),
    Guideline("no2", 25.0, 24, targets={"IT-2": 50.0, "IT-1": 120.0}),
    Guideline("o3", 100.0, 8, targets={"IT-2": 120.0, "IT-1": 160.0}),
    Guideline("so2", 40.0, 24, targets={"IT-2": 50.0, "IT-1": 125.0}),
    Guideline("co", 4.0, 24, targets={"IT-1": 7.0}),
]
MINIMUM_COVERAGE = 75.0
EVENT_THRESHOLD = 15.0


def _judged(g: Guideline, average: Column, coverage: Column, minimum: float) -> list[Column]:
    limited = ~F.col("city").isin(*g.cities) if g.cities is not None else F.lit(False)
    absent = limited if g.cities is not None else F.col(g.pollutant).isNull()
    usable = (coverage >= minimum) & average.isNotNull() & ~absent
    fallback = F.when(limited, ABSENT).otherwise(INSUFFICIENT)
    if not g.unit_compatible:
        label = F.when(usable, UNIT).otherwise(fallback)
        nothing = F.lit(None)
        return [
            label.alias("status"),
            nothing.cast("boolean").alias("exceeded"),
            nothing.cast("double").alias("ratio"),
            label.alias("interim_level"),
        ]
    level = F.when(average <= g.guideline, "AQG")
    for name, top in sorted(g.targets.items(), key=lambda item: item[1]):
        level = level.when(average <= top, name)
    level = level.otherwise("Beyond IT-1")
    status = F.when(average <= g.guideline, MEETS).otherwise(ABOVE)
    return [
        F.when(usable, status).otherwise(fallback).alias("status"),
        F.when(usable, average > g.guideline).alias("exceeded"),
        F.when(usable, average / g.guideline).alias("ratio"),
        F.when(usable, level).otherwise(fallback).alias("interim_level"),
    ]


def window_averages(
    df: DataFrame, s: Series, guidelines: Sequence[Guideline]
) -> DataFrame:
    """Segmented rows plus ``<pollutant>_avg`` and ``<pollutant>_coverage``."""
    used = [g for g in guidelines if g.pollutant in df.columns]
    spread = time_halo(df, s, max(g.hours for g in used) * 60)
    w = frame_window(s, "segment")
    extra = []
    for g in used:
        frame = left_open(w, g.hours * 60)
        expected = g.hours * 60 / s.cadence_minutes
        share = window_stat(frame, g.pollutant, "count") / expected * 100
        extra += [
            window_stat(frame, g.pollutant, "mean").alias(f"{g.pollutant}_avg"),
            F.least(share, F.lit(100.0)).alias(f"{g.pollutant}_coverage"),
        ]
    return home_rows(spread.select("*", *extra))


def who_windows(
    df: DataFrame,
    s: Series,
    guidelines: Sequence[Guideline] = WHO_2021,
    minimum: float = MINIMUM_COVERAGE,
) -> DataFrame:
    """One row per reading and pollutant: average, coverage, status, ratio, interim level."""
    used = [g for g in guidelines if g.pollutant in df.columns]
    wide = window_averages(df, s, used)
    rows = []
    for g in used:
        average, coverage = F.col(f"{g.pollutant}_avg"), F.col(f"{g.pollutant}_coverage")
        rows.append(
            F.struct(
                F.lit(g.pollutant).alias("pollutant"),
                F.lit(f"{g.hours}h").alias("averaging_period"),
                average.alias("average"),
                coverage.alias("coverage_percent"),
                F.lit(g.guideline).alias("guideline"),
                F.lit(g.unit_compatible).alias("unit_compatible"),
                *_judged(g, average, coverage, minimum),
            )
        )
    return wide.select(*s.keys, "city", s.ts, F.explode(F.array(*rows)).alias("_w")).select(
        *s.keys, "city", s.ts, "_w.*"
    )


def who_coverage(
    windows: DataFrame, keys: Sequence[str], minimum: float = MINIMUM_COVERAGE
) -> DataFrame:
    return windows.groupBy(*keys, "pollutant").agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg("coverage_percent").alias("mean_coverage"),
        F.count_if(F.col("coverage_percent") >= minimum).alias("valid_windows"),
    )


def who_exceedances(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    valid = F.count_if(F.col("exceeded").isNotNull())
    above = F.count_if(F.col("exceeded"))
    return windows.groupBy(*keys, "pollutant").agg(
        valid.alias("valid_windows"),
        above.alias("exceeded_windows"),
        F.when(valid > 0, 100 * above / valid).alias("exceeded_percent"),
    )


def latest_status(windows: DataFrame, s: Series) -> DataFrame:
    """Latest usable window per key and pollutant, else the latest one."""
    usable = ~F.col("status").isin(INSUFFICIENT, ABSENT)
    rest = [c for c in windows.columns if c not in (*s.keys, "pollutant")]
    newest = windows.groupBy(*s.keys, "pollutant").agg(
        F.max_by(F.struct(*rest), F.struct(usable, F.col(s.ts))).alias("_r")
    )
    return newest.select(*s.keys, "pollutant", "_r.*")


def overall_status(latest: DataFrame, s: Series) -> DataFrame:
    """Per key: the pollutant furthest above its guideline, else a supported one."""
    rank = F.when(F.col("status") == ABOVE, F.col("ratio")).otherwise(F.lit(-1.0))
    # Pollutants of one key are few; ties go to the alphabetically first.
    supported = latest.where("unit_compatible")
    chosen = supported.groupBy(*s.keys).agg(
        F.min_by(F.struct("status", "pollutant"), F.struct(-rank, F.col("pollutant"))).alias("_c")
    )
    return (
        latest.select(*s.keys, "city")
        .distinct()
        .join(chosen, list(s.keys), "left")
        .select(
            *s.keys,
            "city",
            F.coalesce("_c.status", F.lit(INSUFFICIENT)).alias("overall_status"),
            F.upper("_c.pollutant").alias("dominant_pollutant"),
        )
    )


def network_status(overall: DataFrame, latest: DataFrame) -> DataFrame:
    """Sensors online, above guideline, and above twice the guideline."""
    worst = latest.where("unit_compatible").groupBy("sensor_id").agg(F.max("ratio").alias("_r"))
    return overall.join(worst, "sensor_id", "left").agg(
        F.count(F.lit(1)).alias("sensors"),
        F.count_if(F.col("overall_status") != INSUFFICIENT).alias("online"),
        F.count_if((F.col("_r") > 1) & (F.col("_r") <= 2)).alias("elevated"),
        F.count_if(F.col("_r") > 2).alias("high"),
    )


def forecast_targets(
    df: DataFrame, s: Series, horizons: Sequence[int], minimum: float = MINIMUM_COVERAGE
) -> DataFrame:
    """Exact future values, future averages, event labels, gap flags and validity.

    ``df`` carries ``segment``, ``pm25_avg``, ``pm25_coverage``, ``pm25_lag_6h``,
    ``pm25_mean_3h`` and ``missing_flag``.  A gap counts when the reading it
    starts at lies inside ``[t, t + h)``, so the look-ahead is bounded.
    """
    silence = F.col("_next")["_us"] - F.col("_us")
    marked = time_halo(
        with_next(df.drop("_us"), s, [])
        .withColumn("_breaks", F.coalesce(silence > s.gap_minutes * MINUTE, F.lit(False)))
        .drop("_next", "_blk"),
        s,
        ahead_minutes=max(horizons),
    )
    sensor, seg = frame_window(s), frame_window(s, "segment")
    cols: list[Column] = []
    for m in horizons:
        h = lag_label(m)
        inside = sensor.rangeBetween(0, m * MINUTE - 1)
        cols += [
            shift_exact(seg, "pm25", m).alias(f"target_pm25_{h}"),
            shift_exact(seg, "pm25_avg", m).alias(f"target_pm25_who_24h_avg_{h}"),
            shift_exact(seg, "pm25_coverage", m).alias(f"_cov_{h}"),
            F.bool_or("_breaks").over(inside).alias(f"future_gap_{h}"),
        ]
    wide = home_rows(marked.select("*", *cols)).drop("_breaks")
    history = F.col("pm25_lag_6h").isNotNull() & F.col("pm25_mean_3h").isNotNull()
    issue = F.col("pm25").isNull() | F.col("missing_flag")
    derived: list[Column] = [history.alias("history_available"), issue.alias("quality_issue")]
    for m in horizons:
        h = lag_label(m)
        target, average = F.col(f"target_pm25_{h}"), F.col(f"target_pm25_who_24h_avg_{h}")
        gap = F.col(f"future_gap_{h}")
        reason = (
            F.when(~history, "INSUFFICIENT_HISTORY")
            .when(gap, "FUTURE_MAJOR_GAP")
            .when(target.isNull(), "MISSING_FUTURE_TARGET")
            .when(issue, "QUALITY_ISSUE")
            .otherwise("VALID")
        )
        derived += [
            F.when(
                average.isNotNull() & (F.col(f"_cov_{h}") >= minimum),
                (average > EVENT_THRESHOLD).cast("long"),
            ).alias(f"pollution_event_{h}"),
            reason.alias(f"reason_{h}"),
            (reason == "VALID").alias(f"forecast_sample_valid_{h}"),
        ]
    return wide.select("*", *derived).drop(*[f"_cov_{lag_label(m)}" for m in horizons])


def sample_validity(targets: DataFrame, s: Series, horizons: Sequence[int]) -> DataFrame:
    """Long form: one row per reading and horizon."""
    rows = [
        F.struct(
            F.lit(lag_label(m)).alias("horizon"),
            F.col(f"forecast_sample_valid_{lag_label(m)}").alias("forecast_sample_valid"),
            F.col("history_available"),
            F.col(f"target_pm25_{lag_label(m)}").isNotNull().alias("future_target_available"),
            F.col(f"future_gap_{lag_label(m)}").alias("future_major_gap"),
            F.col("quality_issue"),
            F.col(f"reason_{lag_label(m)}").alias("invalid_reason"),
            F.col(f"pollution_event_{lag_label(m)}").alias("pollution_event"),
        )
        for m in horizons
    ]
    return targets.select(*s.keys, "city", s.ts, F.explode(F.array(*rows)).alias("_v")).select(
        *s.keys, "city", s.ts, "_v.*"
    )


def sample_validity_summary(validity: DataFrame, s: Series) -> DataFrame:
    """Counts by reason per key and horizon; the key is null on the total rows."""

    def reason(name: str) -> Column:
        return F.count_if(F.col("invalid_reason") == name)

    key = s.keys[0]
    return validity.groupingSets(
        [[F.col("horizon"), F.col(key)], [F.col("horizon")]], F.col("horizon"), F.col(key)
    ).agg(
        F.count(F.lit(1)).alias("total_timestamps"),
        F.count_if(F.col("forecast_sample_valid")).alias("valid_samples"),
        reason("INSUFFICIENT_HISTORY").alias("invalid_history"),
        reason("FUTURE_MAJOR_GAP").alias("invalid_future_gap"),
        reason("MISSING_FUTURE_TARGET").alias("invalid_missing_target"),
        reason("QUALITY_ISSUE").alias("invalid_quality"),
        F.count("pollution_event").alias("event_labels"),
        F.count_if(F.col("pollution_event") == 1).alias("positive_events"),
    )
