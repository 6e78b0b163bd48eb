"""Queries over segments, shifts, windows, grids and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import series as S
from sensorloom.plans.network import (
    HOURLY, OBS, RAW, READINGS, SEG, USERS, observations, query_table, readings, rounded, sql,
    user_readings,
)

QUERIES, SQL, query = query_table()


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.segment_series(observations(spark, sf), HOURLY)


@query("segment_series", sql(SEG, """
SELECT sensor_id, ts, segment, sensor_id || '-' || segment AS segment_id, minutes_since_previous
FROM seg"""))
def _(spark, sf):
    return segments(spark, sf).select(
        "sensor_id", "ts", "segment", S.segment_id(HOURLY).alias("segment_id"),
        "minutes_since_previous",
    )


@query("segment_series_raw", sql(READINGS, """,
prior AS (SELECT *, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS pts FROM readings),
seg AS (SELECT *, sum(CASE WHEN pts IS NULL OR ts > pts + INTERVAL 90 MINUTE OR ts <= pts
                THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS segment
        FROM prior)
SELECT sensor_id, CAST(segment AS BIGINT) AS segment, min(ts) AS start_time, max(ts) AS end_time,
       count(*) AS readings
FROM seg GROUP BY ALL"""))
def _(spark, sf):
    rows = readings(spark, sf)
    return S.segment_series(rows, S.fit_blocks(rows, RAW)).groupBy("sensor_id", "segment").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("readings"),
    )


@query("segment_series_users", sql(READINGS, """,
prior AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts FROM readings),
seg AS (SELECT user_id, sum(CASE WHEN pts IS NULL OR ts > pts + INTERVAL 1440 MINUTE OR ts <= pts
                THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment
        FROM prior)
SELECT user_id AS sensor_id, CAST(max(segment) AS BIGINT) AS segments, count(*) AS readings
FROM seg GROUP BY ALL"""))
def _(spark, sf):
    return S.segment_series(user_readings(spark, sf), USERS).groupBy("sensor_id").agg(
        F.max("segment").alias("segments"), F.count(F.lit(1)).alias("readings")
    )


@query("exact_lag", sql(SEG, """
SELECT a.sensor_id, a.ts, b.pm25 AS pm25_lag_1h, c.pm25 AS pm25_lag_3h, d.pm25 AS pm25_lag_6h,
       e.temperature AS temperature_lag_1h
FROM seg a
LEFT JOIN seg b ON b.sensor_id = a.sensor_id AND b.segment = a.segment AND b.ts = a.ts - INTERVAL 1 HOUR
LEFT JOIN seg c ON c.sensor_id = a.sensor_id AND c.segment = a.segment AND c.ts = a.ts - INTERVAL 3 HOUR
LEFT JOIN seg d ON d.sensor_id = a.sensor_id AND d.segment = a.segment AND d.ts = a.ts - INTERVAL 6 HOUR
LEFT JOIN seg e ON e.sensor_id = a.sensor_id AND e.segment = a.segment AND e.ts = a.ts - INTERVAL 1 HOUR""",
           "pm25_lag_1h pm25_lag_3h pm25_lag_6h temperature_lag_1h"))
def _(spark, sf):
    names = {
        "pm25_lag_1h": ("pm25", -60), "pm25_lag_3h": ("pm25", -180),
        "pm25_lag_6h": ("pm25", -360), "temperature_lag_1h": ("temperature", -60),
    }
    out = S.exact_shifts(segments(spark, sf), HOURLY, names)
    return rounded(out.select("sensor_id", "ts", *names))


@query("exact_lead", sql(SEG, """
SELECT a.sensor_id, a.ts, b.pm25 AS target_1h, c.pm25 AS target_3h, d.pm25 AS target_6h
FROM seg a
LEFT JOIN seg b ON b.sensor_id = a.sensor_id AND b.segment = a.segment AND b.ts = a.ts + INTERVAL 1 HOUR
LEFT JOIN seg c ON c.sensor_id = a.sensor_id AND c.segment = a.segment AND c.ts = a.ts + INTERVAL 3 HOUR
LEFT JOIN seg d ON d.sensor_id = a.sensor_id AND d.segment = a.segment AND d.ts = a.ts + INTERVAL 6 HOUR""",
           "target_1h target_3h target_6h"))
def _(spark, sf):
    names = {"target_1h": ("pm25", 60), "target_3h": ("pm25", 180), "target_6h": ("pm25", 360)}
    out = S.exact_shifts(segments(spark, sf), HOURLY, names)
    return rounded(out.select("sensor_id", "ts", *names))


@query("backward_rolling", sql(SEG, """
SELECT sensor_id, ts, round(avg(pm25) OVER w, 6) AS pm25_mean_3h,
       round(quantile_cont(pm25, 0.5) OVER w, 6) AS pm25_median_3h,
       round(stddev_samp(pm25) OVER w, 6) AS pm25_std_3h, min(pm25) OVER w AS pm25_min_3h,
       max(pm25) OVER w AS pm25_max_3h, count(pm25) OVER w AS pm25_count_3h,
       round(avg(temperature) OVER d, 6) AS temperature_mean_24h, count(no2) OVER d AS no2_count_24h
FROM seg
WINDOW w AS (PARTITION BY sensor_id, segment ORDER BY ts
             RANGE BETWEEN INTERVAL '10799.999999 seconds' PRECEDING AND CURRENT ROW),
       d AS (PARTITION BY sensor_id, segment ORDER BY ts
             RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)""",
           "pm25_min_3h pm25_max_3h"))
def _(spark, sf):
    wanted = {f"pm25_{stat}_3h": ("pm25", 180, stat)
              for stat in ["mean", "median", "std", "min", "max", "count"]}
    wanted["temperature_mean_24h"] = ("temperature", 1440, "mean")
    wanted["no2_count_24h"] = ("no2", 1440, "count")
    out = S.backward_rolling(segments(spark, sf), HOURLY, wanted)
    return rounded(out.select("sensor_id", "ts", *wanted))


@query("resample_grid", sql(READINGS, """,
cells AS (SELECT sensor_id, city, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS pm25,
                 count(*) AS n FROM readings GROUP BY ALL),
spans AS (SELECT sensor_id, city, min(ts) AS a, max(ts) AS b FROM cells GROUP BY ALL),
grid AS (SELECT sensor_id, city, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM spans)
SELECT sensor_id, city, ts, round(pm25, 6) AS pm25, n FROM grid LEFT JOIN cells USING (sensor_id, city, ts)"""))
def _(spark, sf):
    out = S.resample_grid(
        readings(spark, sf), RAW, {"pm25": F.avg("value"), "n": F.count(F.lit(1))}, ["city"]
    )
    return rounded(out.select("sensor_id", "city", "ts", "pm25", "n"))


@query("stride_sample", sql(OBS, """,
numbered AS (SELECT sensor_id, ts, pm25, row_number() OVER (PARTITION BY sensor_id ORDER BY ts) - 1 AS o,
                    count(*) OVER (PARTITION BY sensor_id) AS n FROM obs),
stepped AS (SELECT *, greatest(1, CAST(ceil(n / 200.0) AS BIGINT)) AS step FROM numbered)
SELECT sensor_id, ts, pm25 FROM stepped WHERE o % step = 0""", "pm25"))
def _(spark, sf):
    out = S.stride_sample(observations(spark, sf), HOURLY, 200)
    return rounded(out.select("sensor_id", "ts", "pm25"))
