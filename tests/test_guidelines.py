from conftest import at

from sensorloom.operators import features, guidelines, series
from sensorloom.operators.guidelines import Guideline
from sensorloom.operators.series import Series

S = Series()


def frame(spark, n=96, city="A", skip=()):
    rows = [
        (1, city, at(15 * i), 10.0 + (i % 3), 40.0 if city == "A" else None)
        for i in range(n)
        if i not in skip
    ]
    return spark.createDataFrame(
        rows, "sensor_id int, city string, ts timestamp_ntz, pm25 double, no2 double"
    )


def windows(df, *guides):
    return guidelines.who_windows(series.segment_series(df, S), S, guides).orderBy("ts").collect()


def test_short_coverage_is_insufficient(spark):
    got = windows(frame(spark), Guideline("pm25", 15.0))
    assert got[70].status == guidelines.INSUFFICIENT and got[70].ratio is None
    assert got[71].coverage_percent == 75.0 and got[71].status == guidelines.MEETS
    assert got[-1].interim_level == "AQG"


def test_incompatible_unit_has_no_ratio(spark):
    got = windows(frame(spark), Guideline("no2", 25.0, unit_compatible=False))
    assert got[-1].status == guidelines.UNIT and got[-1].ratio is None and got[-1].exceeded is None


def test_structural_absence_is_not_available(spark):
    got = windows(frame(spark, city="B"), Guideline("no2", 25.0, cities=("A",)))
    assert {r.status for r in got} == {guidelines.ABSENT} and {r.average for r in got} == {None}


def test_interim_levels_are_ordered(spark):
    got = windows(frame(spark), Guideline("no2", 25.0, targets={"IT-1": 120.0, "IT-2": 50.0}))
    assert got[-1].interim_level == "IT-2" and got[-1].exceeded
    got = windows(frame(spark), Guideline("no2", 25.0, targets={"IT-1": 30.0}))
    assert got[-1].interim_level == "Beyond IT-1"


def test_targets_and_validity(spark):
    df = frame(spark, n=160, skip=range(120, 130)).selectExpr(
        "*", "20.0 AS temperature", "50.0 AS humidity", "1.0 AS o3", "no2 IS NULL AS missing_flag"
    )
    seg = series.segment_series(df, S)
    rows = features.engineer_features(seg, S, features.QUARTER_HOUR_PLAN)
    rows = guidelines.window_averages(rows, S, [Guideline("pm25", 15.0)])
    out = guidelines.forecast_targets(rows, S, [60, 180]).orderBy("ts").collect()
    by = {r.ts: r for r in out}
    assert by[at(0)].reason_1h == "INSUFFICIENT_HISTORY"
    assert by[at(15 * 50)].reason_1h == "VALID" and by[at(15 * 50)].target_pm25_1h == 10.0 + 54 % 3
    assert by[at(15 * 118)].reason_1h == "FUTURE_MAJOR_GAP"
    assert by[at(15 * 110)].future_gap_3h and not by[at(15 * 110)].future_gap_1h
    assert by[at(15 * 159)].reason_1h in ("INSUFFICIENT_HISTORY", "MISSING_FUTURE_TARGET")
    assert by[at(15 * 80)].pollution_event_1h == 0


def test_features_do_not_change_when_the_future_arrives(spark):
    df = frame(spark, n=60).selectExpr("*", "20.0 AS temperature", "50.0 AS humidity", "1.0 AS o3")
    cut = df.where(f"ts <= TIMESTAMP_NTZ '{at(15 * 40)}'")

    def table(d):
        f = features.engineer_features(series.segment_series(d, S), S, features.QUARTER_HOUR_PLAN)
        names = [c for c in f.columns if not c.startswith("_")]
        return {r.ts: tuple(r) for r in f.select(*names).collect()}

    whole, part = table(df), table(cut)
    assert all(whole[t] == v for t, v in part.items()) and len(part) == 41


def test_column_gate():
    features.column_gate(["a", "b"], ["a"], ["target_"])
    for bad in (["c"], ["target_x"]):
        try:
            features.column_gate(["a", "target_x"], bad, ["target_"])
        except ValueError:
            continue
        raise AssertionError(bad)
