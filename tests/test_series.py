import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorloom.operators import audit, quality, relations, series
from sensorloom.operators.series import Series

S = Series()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_segments_restart_after_a_gap(segment_frame):
    out = series.segment_series(segment_frame(), S)
    assert [r.segment for r in out.orderBy("ts").collect()] == [1] * 10 + [2] * 4


def test_a_gap_of_exactly_the_limit_stays_joined(spark):
    data = [(1, at(0)), (1, at(90)), (1, at(180.01))]
    df = spark.createDataFrame(data, "sensor_id int, ts timestamp_ntz")
    assert [r.segment for r in series.segment_series(df, S).orderBy("ts").collect()] == [1, 1, 2]


def test_a_repeated_timestamp_opens_a_segment(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(0)), (1, at(15))], "sensor_id int, ts timestamp_ntz")
    assert sorted(r.segment for r in series.segment_series(df, S).collect()) == [1, 2, 2]


def test_exact_lag_never_crosses_a_gap(segment_frame):
    seg = series.segment_series(segment_frame(), S)
    out = series.exact_shifts(seg, S, {"lag": ("pm25", -15), "lead": ("pm25", 60)})
    got = [(r.lag, r.lead) for r in out.orderBy("ts").collect()]
    assert got[1][0] == 1.0 and got[10][0] is None
    assert got[0][1] == 5.0 and got[9][1] is None and got[13][1] is None


def test_rolling_window_is_left_open(segment_frame):
    seg = series.segment_series(segment_frame(), S)
    out = series.backward_rolling(
        seg, S, {"mean": ("pm25", 60, "mean"), "count": ("pm25", 60, "count")}
    )
    got = [(r["mean"], r["count"]) for r in out.orderBy("ts").collect()]
    assert got[1] == (1.5, 2)
    assert got[4] == (3.5, 4)  # the value 60 minutes ago is outside
    assert got[10] == (11.0, 1)


def random_series(spark, seed, n=400):
    rng = random.Random(seed)
    out, us = [], {k: 0.0 for k in "ab"}
    for i in range(n):
        k = rng.choice("aab")
        us[k] += rng.choice([15, 15, 15, 30, 45, 200, 1000])
        out.append((k, at(us[k]), i, rng.choice([None, 1.0, 1.0, 2.0, rng.random()])))
    return spark.createDataFrame(out, "sensor_id string, ts timestamp_ntz, n int, value double")


@pytest.mark.parametrize("seed", [1, 2])
def test_results_do_not_depend_on_the_block_length(spark, seed):
    df = random_series(spark, seed)
    wide = replace(S, block_hours=24 * 365 * 10)
    for s in (replace(S, block_hours=1), replace(S, block_hours=7)):
        for build in (
            lambda q: series.segment_series(df, q).select("sensor_id", "n", "segment"),
            lambda q: series.with_ordinal(df, q).select("sensor_id", "n", "_ord"),
            lambda q: series.with_previous(df, q, ["n"]).select("sensor_id", "n", "_prev.n"),
            lambda q: series.backward_rolling(
                series.segment_series(df, q), q, {"m": ("value", 180, "median"), "s": ("value", 45, "std")}
            ).select("sensor_id", "n", "m", "s"),
            lambda q: quality.flatline_runs(
                df.withColumn("channel", F.lit("c")), q, minimum=2
            ).select("sensor_id", "start_time", "end_time", "readings"),
            lambda q: audit.missing_runs(df.withColumn("channel", F.lit("c")), q).select(
                "sensor_id", "start_time", "end_time", "readings"
            ),
        ):
            assert sorted(map(repr, rows(build(s), "sensor_id"))) == sorted(
                map(repr, rows(build(wide), "sensor_id"))
            )


def test_grid_fills_every_bucket_once(spark):
    df = spark.createDataFrame(
        [(1, at(0), 1.0), (1, at(5), 3.0), (1, at(61), 5.0)],
        "sensor_id int, ts timestamp_ntz, value double",
    )
    for hours in (1, 24):
        out = series.resample_grid(df, replace(S, block_hours=hours), {"v": F.avg("value")})
        assert [r.v for r in out.orderBy("ts").collect()] == [2.0, None, None, None, 5.0]


@pytest.mark.parametrize("both", [False, True])
def test_short_gap_interpolation_matches_pandas(spark, both):
    rng = random.Random(3)
    values = [None if rng.random() < 0.45 else float(rng.randint(0, 99)) for _ in range(120)]
    values[0] = values[1] = values[-1] = None
    data = [(1, "c", at(15 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "sensor_id int, channel string, ts timestamp_ntz, value double")
    got = {r.ts: r.value for r in relations.short_gap_interpolate(df, S, 2, both).collect()}
    want = pd.Series(values, index=[d[2] for d in data], dtype=float).interpolate(
        limit=2, limit_direction="both" if both else "forward"
    )
    want = want.dropna()
    assert set(got) == {t.to_pydatetime() for t in want.index}
    assert all(abs(got[t.to_pydatetime()] - v) < 1e-9 for t, v in want.items())


def test_partial_autocorrelation_solves_the_yule_walker_equations(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(300)
    for i in range(2, 300):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    df = spark.createDataFrame(
        [(1, "c", at(15 * i), float(v)) for i, v in enumerate(x)],
        "sensor_id int, channel string, ts timestamp_ntz, value double",
    )
    got = [r.pacf for r in relations.partial_autocorrelation(df, S, 4).orderBy("lag").collect()]
    c = x - x.mean()
    r = np.array([c[k:] @ c[: 300 - k] for k in range(5)]) / (c @ c)
    want = [
        np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])[-1]
        for k in range(1, 5)
    ]
    assert np.allclose(got, want, atol=1e-9)


def test_leave_one_out_median(spark):
    rng = random.Random(5)
    data = [(t, s, float(rng.randint(0, 9))) for t in range(40) for s in range(rng.randint(1, 6))]
    df = spark.createDataFrame(data, "t int, sensor_id int, v double")
    got = {(r.t, r.sensor_id): r.m for r in relations.leave_one_out_median(df, ["t"], "v", "m").collect()}
    for t, s, _ in data:
        others = [v for (u, q, v) in data if u == t and q != s]
        want = float(np.median(others)) if others else None
        assert got[(t, s)] == want


def test_gap_events_round_half_even(spark):
    minutes = [0, 15, 30, 45, 60, 60 + 37.5, 60 + 37.5 + 15]
    df = spark.createDataFrame([(1, at(m)) for m in minutes], "sensor_id int, ts timestamp_ntz")
    got = audit.gap_events(df, S).collect()
    assert [(r.missing_readings, r.severity) for r in got] == [(1, "MINOR")]  # round(2.5) = 2


def test_a_sample_spans_the_whole_series(spark):
    from sensorloom.operators.series import Series, stride_sample

    s = Series(cadence_minutes=15, gap_minutes=90)
    for n, most in ((1003, 100), (600, 600), (599, 300), (5, 100)):
        rows = spark.createDataFrame([(1, at(15 * i), i) for i in range(n)], "sensor_id int, ts timestamp_ntz, i int")
        got = sorted(r.i for r in stride_sample(rows, s, most).collect())
        step = -(-n // most)
        assert got == list(range(0, n, step)) and len(got) <= most and n - 1 - got[-1] < step


def test_all_changes_of_a_run_are_returned(spark):
    from sensorloom.operators.anomalies import change_points
    from sensorloom.operators.series import Series

    s = Series(cadence_minutes=60, gap_minutes=90)
    value = lambda i: 10.0 + 5 * (i // 72 % 2) + 0.01 * (i % 7)
    rows = [(1, at(60 * i), "pm25", value(i)) for i in range(72 * 13)]
    long = spark.createDataFrame(rows, "sensor_id int, ts timestamp_ntz, channel string, value double")
    found = change_points(long, s, window_rows=24, least_days=3, penalty=2.0).collect()
    assert len(found) >= 12 and sorted(r["rank"] for r in found) == list(range(1, len(found) + 1))


def test_profile_means_do_not_depend_on_the_order_of_rows(spark):
    """Ten values of 0.1 add up to 1; added one by one in doubles they give 0.9999999999999999."""
    from sensorloom.operators.stats import temporal_profile

    odd = [("b", 1.0), ("b", float("inf")), ("c", 1.0), ("c", float("nan"))]
    rows = [("a", "pm25", at(60), 0.1)] * 10 + [(sensor, "pm25", at(60), value) for sensor, value in odd]
    df = spark.createDataFrame(rows, "sensor_id string, channel string, ts timestamp_ntz, value double")
    for parts in (1, 7):
        means = {r.sensor_id: r.mean for r in temporal_profile(df.repartition(parts), Series()).collect()}
        assert (means["a"], means["b"], str(means["c"])) == (0.1, float("inf"), "nan")
