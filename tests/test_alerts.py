import hashlib
import random
from dataclasses import replace

import pytest
from conftest import at

from sensorloom.operators import alerts as A

FORECAST = (
    "sensor_id int, ts timestamp_ntz, horizon string, forecast double, "
    "safety_upper_estimate double, safety_margin double, future_24h_average double, "
    "risk_level string, who_status string, ratio_to_guideline double"
)
ISSUE = "sensor_id int, ts timestamp_ntz, type string, severity string, channel string, evidence map<string,double>"


def forecast(minute, horizon="1h", risk="Normal", who="Meets WHO Guideline"):
    return (2, at(minute), horizon, 20.0, 25.0, 5.0, 14.0, risk, who, 0.9)


def run(spark, forecasts, issues=(), health=(), cooldown=60, hours=24 * 7):
    f = spark.createDataFrame(list(forecasts), FORECAST)
    i = spark.createDataFrame(list(issues), ISSUE)
    h = spark.createDataFrame([(2, at(m)) for m in health], "sensor_id int, ts timestamp_ntz")
    conditions = A.alert_conditions(f, i)
    out = A.alert_lifecycle(
        conditions, A.evaluations(f, h), cooldown, replace(A.ALERTS, block_hours=hours)
    )
    return sorted(out.collect(), key=lambda r: (r.dedup_key, r.ts))


def steps(rows):
    return [(r.transition, r.notification_recommended) for r in rows]


def test_policy(spark):
    f = [forecast(0, "1h", "High"), forecast(0, "3h", "High"), forecast(0, "6h", "Elevated")]
    got = {
        r.horizon: (r.severity, r.priority)
        for r in A.forecast_conditions(spark.createDataFrame(f, FORECAST)).collect()
    }
    assert got == {"1h": ("critical", "urgent"), "3h": ("warning", "high"), "6h": ("warning", "medium")}


def test_repeat_inside_the_cooldown_is_suppressed(spark):
    got = run(spark, [forecast(15 * i, risk="Elevated") for i in range(6)])
    assert steps(got) == [
        ("new", True), ("updated", False), ("updated", False), ("updated", False),
        ("updated", True), ("updated", False),
    ]
    assert len({r.id for r in got}) == 1


def test_escalation_bypasses_the_cooldown(spark):
    got = run(spark, [forecast(0, risk="Elevated"), forecast(15, risk="High"), forecast(30, risk="High")])
    assert steps(got) == [("new", True), ("escalated", True), ("updated", False)]


def test_resolve_and_return_with_a_new_id(spark):
    got = run(spark, [forecast(0, risk="High"), forecast(15), forecast(30, risk="High")])
    assert steps(got) == [("new", True), ("resolved", False), ("new", True)]
    assert got[0].id == got[1].id != got[2].id
    text = "2:high_pm_risk:1h:pm25|2026-01-01T00:00:00+00:00"
    assert got[0].id == "alert_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def test_only_supplied_sources_resolve(spark):
    f = [forecast(0, "1h", "High"), forecast(0, "3h", "High"), forecast(15, "1h")]
    got = run(spark, f, health=[30])
    assert [(r.horizon, r.transition) for r in got if r.transition != "resolved"] == [
        ("1h", "new"), ("3h", "new"),
    ]
    assert [r.dedup_key for r in got if r.transition == "resolved"] == ["2:high_pm_risk:1h:pm25"]


def test_health_conditions(spark):
    issues = [
        (2, at(0), "offline", "critical", None, {}),
        (2, at(0), "possible_drift", "warning", "pm25", {}),
        (2, at(0), "suspicious_value", "critical", "humidity", {}),
        (2, at(0), "jump", "warning", "pm25", {}),
    ]
    got = run(spark, [], issues, health=[0, 15])
    assert sorted({r.dedup_key for r in got}) == [
        "2:possible_drift:pm25", "2:sensor_offline", "2:suspicious_reading:humidity",
    ]
    assert [r.transition for r in got] == ["new", "resolved"] * 3


def naive(sequence, cooldown):
    """One key, evaluation by evaluation."""
    out, active, last, rank = [], False, None, None
    for minute, level in sequence:
        if level is None:
            if active:
                out.append(("resolved", False))
            active = False
            continue
        if not active:
            out.append(("new", True))
            active, last = True, minute
        else:
            up = level > rank
            hit = up or minute - last >= cooldown
            last = minute if hit else last
            out.append(("escalated" if up else "updated", hit))
        rank = level
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hours", [1, 2, 24 * 30])
def test_block_folds_equal_the_sequential_fold(spark, seed, hours):
    rng = random.Random(seed)
    minute, sequence = 0, []
    for _ in range(120):
        minute += rng.choice([5, 15, 15, 20, 50, 130])
        sequence.append((minute, rng.choice([None, 0, 0, 0, 0, 1])))
    names = {None: "Normal", 0: "Elevated", 1: "High"}
    got = run(spark, [forecast(m, risk=names[v]) for m, v in sequence], hours=hours, cooldown=70)
    assert steps(got) == naive(sequence, 70)


def test_evaluations_are_joined_once_for_the_block_maps(spark, monkeypatch):
    staged, real = [], A.stage
    monkeypatch.setattr(A, "stage", lambda df: staged.append(df) or real(df))
    got = run(spark, [forecast(15 * i, risk="Elevated") for i in range(2)])
    assert steps(got) == [("new", True), ("updated", False)]
    marked = next(df for df in staged if "transition" in df.columns)
    assert marked.inputFiles()
