from conftest import at

from sensorloom.operators import series
from sensorloom.operators.series import Series
from sensorloom.sources import tables


def test_the_last_arrival_of_a_stamp_is_kept(spark):
    rows = [
        (1, at(0), 5, 1.0), (1, at(0), 7, 2.0), (1, at(0), 6, 3.0),  # corrected twice, out of order
        (1, at(15), 1, None), (1, at(15), None, 4.0),  # no arrival comes first; the last may be empty
        (2, at(0), None, 5.0), (2, at(0), None, 5.0),  # repeated without an arrival
        (None, at(0), 1, 6.0), (None, at(0), 2, 7.0), (1, None, 3, 8.0),
    ]
    df = spark.createDataFrame(rows, "sensor_id int, ts timestamp_ntz, arrival int, value double")
    want = {(1, at(0), 7, 2.0), (1, at(15), 1, None), (2, at(0), None, 5.0), (None, at(0), 2, 7.0), (1, None, 3, 8.0)}
    for parts in (1, 5):
        got = tables.keep_last(df.repartition(parts), ["sensor_id", "ts"], ["arrival"])
        assert got.columns == df.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert tables.keep_last(df.limit(0), ["sensor_id", "ts"], ["arrival"]).count() == 0


def test_lags_follow_corrections(spark):
    rows = [(1, at(0), 1, 10.0), (1, at(0), 2, 11.0), (1, at(15), 3, 20.0)]
    df = spark.createDataFrame(rows, "sensor_id int, ts timestamp_ntz, arrival int, value double")
    last = tables.keep_last(df, ["sensor_id", "ts"], ["arrival"]).selectExpr("*", "0 AS segment")
    got = series.exact_shifts(last, Series(), {"lag": ("value", -15)}).orderBy("ts").collect()
    assert [(r.value, r.lag) for r in got] == [(11.0, None), (20.0, 11.0)]
