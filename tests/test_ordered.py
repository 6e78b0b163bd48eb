"""Moving order statistics against plain sorting, in functions and over blocks of a series."""

import random
from dataclasses import replace

import numpy as np
import pytest
from conftest import at

from sensorloom.functions import ordered
from sensorloom.operators import health as H
from sensorloom.operators import moving
from sensorloom.operators.series import Series

S = Series()


def quantile(values, p):
    values = np.sort(values)
    place = (len(values) - 1) * p
    low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
    return low + (high - low) * (place - np.floor(place))


@pytest.mark.parametrize("frame", ["growing", "sliding", "any"])
def test_frames_equal_sorting(monkeypatch, frame):
    monkeypatch.setattr(ordered, "_LOAD", 6)
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 90):
        for values in (rng.normal(size=n), np.round(rng.normal(size=n) * 2)):
            ends = np.arange(1, n + 1) if frame != "any" else np.sort(rng.integers(0, n + 1, n))
            begins = np.zeros(n, int) if frame == "growing" else np.maximum(0, ends - 7)
            if frame == "any":
                begins = np.sort(rng.integers(0, n + 1, n))
            got = ordered.frame_scales(values, begins, ends, quarters=True)
            moved = ordered.frame_statistics(values, begins, ends, ["mean", "var", "min", "max", "count"])
            for i in range(n):
                own = values[begins[i] : max(begins[i], ends[i])]
                assert moved["count"][i] == len(own)
                if not len(own):
                    assert np.isnan(got["median"][i]) and np.isnan(moved["mean"][i])
                    continue
                centre = quantile(own, 0.5)
                assert (got["median"][i], got["q1"][i], got["q3"][i]) == (centre, quantile(own, 0.25), quantile(own, 0.75))
                assert got["mad"][i] == pytest.approx(quantile(np.abs(own - centre), 0.5), abs=1e-14)
                assert (moved["min"][i], moved["max"][i]) == (own.min(), own.max())
                assert moved["mean"][i] == pytest.approx(own.mean())
                if len(own) > 1:
                    assert moved["var"][i] == pytest.approx(own.var(ddof=1), abs=1e-12)


def test_steady_stretches():
    rng = np.random.default_rng(1)
    values, limits = np.round(rng.normal(size=300) * 2), np.abs(rng.normal(size=300))
    places = np.sort(rng.integers(0, 300, 300))
    firsts = np.maximum(0, places // 50 * 50)
    got = ordered.steady_starts(values, places, firsts, limits)
    for place, first, limit, start in zip(places, firsts, limits, got):
        want = place
        while want > first and abs(values[want - 1] - values[place]) <= limit:
            want -= 1
        assert start == want


def test_a_long_run_costs_rows_times_a_logarithm():
    import time

    values = np.random.default_rng(2).normal(size=100_000)
    places = np.arange(len(values))
    start = time.process_time()
    ordered.frame_scales(values, np.zeros_like(places), places + 1, quarters=True)
    assert time.process_time() - start < 60


def readings(spark, n=500):
    rng = random.Random(3)
    rows, minute = [], 0
    for i in range(n):
        minute += rng.choice([15, 15, 15, 15, 30] + [600] * (i % 97 == 0))
        value = rng.choice([None, 20.0, 20.0, 20 + rng.random(), 40 * rng.random()])
        rows.append((1, "X", at(minute), value))
    return spark.createDataFrame(rows, "sensor_id int, city string, ts timestamp_ntz, pm25 double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("lookback", [None, 30])
def test_health_references_do_not_depend_on_blocks(spark, lookback):
    rules = replace(H.HealthRules(), lookback=lookback, noise_references=6, drift_recent=8, drift_baseline=12)
    df = readings(spark)
    whole = rows(H.run_statistics(df, S, rules, ["pm25"]), "ts")
    for block_rows in (16, 100):
        assert rows(H.run_statistics(df, S, rules, ["pm25"], block_rows), "ts") == whole


def test_moving_medians_with_parts_shorter_than_the_window(spark):
    df = readings(spark).selectExpr("sensor_id", "ts", "pm25 AS value")
    wanted = {"m": ("value", 1440, "median"), "c": ("value", 1440, "count")}
    whole = rows(moving.moving_statistics(df, replace(S, block_hours=24 * 3650), wanted), "ts")
    short = rows(moving.moving_statistics(df, replace(S, block_hours=1), wanted), "ts")
    assert whole == short
    values = [(r[1], r[2]) for r in whole]
    for _, t, _, _, median, count in whole:
        own = [v for u, v in values if v is not None and 0 <= (t - u).total_seconds() < 86400]
        assert count == len(own)
        assert median is None if not own else median == quantile(np.array(own), 0.5)


def test_spread_of_equal_and_of_close_values_is_not_lost_in_running_sums():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 100, 40), [53.7] * 3, rng.uniform(0, 100, 5), 61.3 + np.arange(3) * 1e-7])
    got = ordered.frame_statistics(x, np.array([40, 48, 0]), np.array([43, 51, 48]), ["std"])["std"]
    assert got[0] == 0
    assert got[1] == pytest.approx(1e-7, rel=1e-6)
    assert got[2] == pytest.approx(x[:48].std(ddof=1), rel=1e-12)
