"""Queries that run Structured Streaming over the given tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorloom.operators import alerts as A
from sensorloom.operators import features as E
from sensorloom.plans.feature_queries import FEATS, PLAN, features, segmented
from sensorloom.plans.health_queries import COOLDOWN, LIFECYCLE, SEG_PLONG, alert_inputs
from sensorloom.plans.network import (
    HOURLY, OBS, READINGS, SEG, hourly, observations, query_table, readings, rounded, sql, table,
)
from sensorloom.sources.staging import stage, staging_folder
from sensorloom.streaming import buffers as B
from sensorloom.streaming import parity as P
from sensorloom.streaming import windows as W

QUERIES, SQL, query = query_table()


#: Rows of a file of a feed.
FILE_ROWS = 100_000


def as_stream(df, slices: int = 4):
    """A table as a stream of files, about one micro-batch per slice of its time span.

    The file source takes files in the order they were written, so the slices are
    written one after the other, each by as many tasks as its rows ask for.
    """
    spark = df.sparkSession
    W.use_rocksdb(spark)
    rows = stage(df)
    low, high, count = rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    files = max(1, -(-count // (slices * FILE_ROWS)))
    path = f"{staging_folder(spark)}/feed-{uuid.uuid4().hex}"
    for i in range(slices):
        start, end = low + (high - low) * i / slices, low + (high - low) * (i + 1) / slices
        inside = (F.col("ts") >= F.lit(start)) & (
            (F.col("ts") < F.lit(end)) if i < slices - 1 else F.lit(True)
        )
        rows.where(inside).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def reading_stream(spark, sf):
    rows = readings(spark, sf).select("sensor_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return as_stream(rows)


FINAL = "(SELECT max(ts) - INTERVAL 30 MINUTE FROM readings)"


@query("tumbling_resample", sql(READINGS, f"""
SELECT sensor_id, time_bucket(INTERVAL 15 MINUTE, ts) AS start, avg(value) AS mean, count(*) AS readings
FROM readings WHERE time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= {FINAL}
GROUP BY sensor_id, time_bucket(INTERVAL 15 MINUTE, ts)""", "mean"))
def _(spark, sf):
    out = W.run_to_end(W.tumbling_resample(reading_stream(spark, sf)))
    return rounded(W.as_ntz(out, "start"))


@query("sliding_rolling", sql(READINGS, f"""
SELECT sensor_id, h + to_hours(w) AS end, avg(value) AS mean, min(value) AS min, max(value) AS max, count(*) AS readings
FROM (SELECT *, date_trunc('hour', ts) AS h, unnest([1, 2, 3]) AS w FROM readings)
WHERE h + to_hours(w) <= {FINAL} GROUP BY sensor_id, h + to_hours(w)""", "mean"))
def _(spark, sf):
    out = W.run_to_end(W.sliding_rolling(reading_stream(spark, sf)))
    return rounded(W.as_ntz(out, "end"))


@query("session_segments", sql(READINGS, f""",
p AS (SELECT *, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS pts FROM readings),
s AS (SELECT *, sum(CASE WHEN pts IS NULL OR ts > pts + INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS seg FROM p)
SELECT sensor_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings FROM s GROUP BY sensor_id, seg
HAVING max(ts) + INTERVAL 90 MINUTE <= {FINAL}"""))
def _(spark, sf):
    out = W.run_to_end(W.session_segments(reading_stream(spark, sf)))
    return W.as_ntz(out, "start_time", "end_time")


def live(spark, sf):
    stream = as_stream(observations(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return W.as_ntz(W.run_to_end(B.live_features(stream, PLAN, HOURLY)), "ts")


@query("history_buffer", sql(SEG, """
SELECT sensor_id, ts, segment::INT AS segment, least(31, row_number() OVER w)::INT AS buffered, row_number() OVER w = 1 AS reset
FROM seg WINDOW w AS (PARTITION BY sensor_id, segment ORDER BY ts)"""))
def _(spark, sf):
    return live(spark, sf).select("sensor_id", "ts", "segment", "buffered", "reset")


@query("history_gate", sql(SEG, """,
b AS (SELECT sensor_id, least(31, row_number() OVER (PARTITION BY sensor_id, segment ORDER BY ts)) AS n FROM seg)
SELECT sensor_id, count(*) FILTER (n >= 1) AS persistence, count(*) FILTER (n >= 25) AS lightgbm, count(*) FILTER (n >= 36) AS lstm FROM b GROUP BY ALL"""))
def _(spark, sf):
    rows = live(spark, sf)
    return rows.groupBy("sensor_id").agg(*[
        F.count_if(B.history_gate(F.col("buffered"), m)).alias(m)
        for m in ("persistence", "lightgbm", "lstm")
    ])


LIVE_NAMES = [*PLAN.lag_names(), *PLAN.rolling_names()]


@query("live_features", sql(SEG + FEATS, f"SELECT sensor_id, ts, {', '.join(LIVE_NAMES)} FROM feats", " ".join(LIVE_NAMES)))
def _(spark, sf):
    return rounded(live(spark, sf).select("sensor_id", "ts", *LIVE_NAMES))


@query("feature_parity_check", sql(OBS, """
SELECT unnest([""" + ", ".join(f"'{n}'" for n in LIVE_NAMES) + """]) AS feature, count(*) AS compared, 0::BIGINT AS failures, true AS within_tolerance FROM obs"""))
def _(spark, sf):
    batch = E.series_features(segmented(observations(spark, sf)), HOURLY, PLAN)
    return P.feature_parity_check(live(spark, sf), batch, ["sensor_id", "ts"], LIVE_NAMES)


@query("causality_check", sql(OBS, """
SELECT unnest([""" + ", ".join(f"'{n}'" for n in LIVE_NAMES) + """]) AS feature, count(*) AS compared, 0::BIGINT AS failures, true AS within_tolerance
FROM obs WHERE ts <= '2024-01-15'"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    past = obs.where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    return P.causality_check(features(obs), features(past), ["sensor_id", "ts"], LIVE_NAMES)


@query("alert_stream", "WITH RECURSIVE " + SEG_PLONG + LIFECYCLE + """
SELECT dedup_key, ts, id, created_at, transition, notification_recommended FROM life""")
def _(spark, sf):
    forecasts, found, health = alert_inputs(spark, sf)
    conditions = stage(A.alert_conditions(forecasts, found))
    rows = A.key_evaluations(conditions, A.evaluations(forecasts, health)).select(
        "dedup_key", F.col("ts").cast("timestamp").alias("ts"), "present",
        F.col("_c.severity_rank").alias("sev"), F.col("_c.priority_rank").alias("pri"),
    )
    out = W.run_to_end(B.live_alerts(as_stream(rows), COOLDOWN))
    return W.as_ntz(out, "ts", "created_at")
