"""Queries over anomalies, regime changes, decomposition and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import anomalies as N
from sensorloom.operators import serving as V
from sensorloom.operators import series as S
from sensorloom.plans.audit_queries import PLONG, provided
from sensorloom.plans.network import (
    CHANNELS, HOURLY, OBS, READINGS, RAW, hourly, observations, query_table, readings, rounded, sql,
    table,
)
from sensorloom.plans.stats_queries import FILLED

QUERIES, SQL, query = query_table()

UNIVARIATE = """,
ord AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY ts) AS o FROM plong),
rm AS (SELECT *, abs(value - CASE WHEN count(value) OVER w >= 24 THEN quantile_cont(value, 0.5) OVER w END) AS dev
       FROM ord WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY o ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
rz AS (SELECT *, dev / nullif(1.4826 * CASE WHEN count(dev) OVER w >= 24 THEN quantile_cont(dev, 0.5) OVER w END, 0) AS rolling_z
       FROM rm WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY o ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
st AS (SELECT sensor_id, channel, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS med,
              quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM plong GROUP BY ALL HAVING count(value) >= 30),
md AS (SELECT sensor_id, channel, 1.482602218505602 * quantile_cont(abs(value - med), 0.5) AS mad
       FROM plong JOIN st USING (sensor_id, channel) GROUP BY ALL),
uni AS (SELECT sensor_id, city, ts, channel, value,
    coalesce(sd > 0 AND abs(value - mean) / sd > 4, false) AS zscore_flag,
    coalesce(mad > 0 AND abs(value - med) / nullif(mad, 0) > 4.5, false) AS mad_flag,
    coalesce(value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1), false) AS iqr_flag,
    coalesce(rolling_z > 5, false) AS rolling_zscore_flag
  FROM rz JOIN st USING (sensor_id, channel) JOIN md USING (sensor_id, channel) WHERE value IS NOT NULL),
cand AS (SELECT *, zscore_flag::INT + mad_flag::INT + iqr_flag::INT + rolling_zscore_flag::INT AS methods_triggered,
    concat_ws(',', CASE WHEN zscore_flag THEN 'zscore' END, CASE WHEN mad_flag THEN 'mad' END, CASE WHEN iqr_flag THEN 'iqr' END,
              CASE WHEN rolling_zscore_flag THEN 'rolling_zscore' END) AS methods
  FROM uni WHERE zscore_flag OR mad_flag OR iqr_flag OR rolling_zscore_flag)"""


def candidates(obs):
    return N.anomaly_candidates(N.anomaly_univariate(provided(obs), HOURLY))


@query("anomaly_univariate", sql(PLONG + UNIVARIATE, "SELECT * FROM uni", "value"))
def _(spark, sf):
    return rounded(N.anomaly_univariate(provided(hourly(spark, sf)), HOURLY))


@query("anomaly_candidates", sql(PLONG + UNIVARIATE, "SELECT sensor_id, ts, channel, methods_triggered, methods FROM cand"))
def _(spark, sf):
    return candidates(hourly(spark, sf)).select(
        "sensor_id", "ts", "channel", "methods_triggered", "methods"
    )


CHANGES = FILLED + """,
f0 AS (SELECT *, CASE WHEN ts = lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM filled
       WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
f1 AS (SELECT *, sum(o) OVER (PARTITION BY sensor_id, channel ORDER BY ts) AS run FROM f0),
sc AS (SELECT sensor_id, channel, run, count(*) AS n, stddev_pop(value) AS sd FROM f1 GROUP BY ALL HAVING count(*) >= 72 AND stddev_pop(value) > 0),
cw AS (SELECT f1.*, n, sd, avg(value) OVER b AS m0, avg(value) OVER a AS m1, var_pop(value) OVER b AS v0, var_pop(value) OVER a AS v1,
              count(*) OVER b AS n0, count(*) OVER a AS n1
       FROM f1 JOIN sc USING (sensor_id, channel, run)
       WINDOW b AS (PARTITION BY sensor_id, channel, run ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
              a AS (PARTITION BY sensor_id, channel, run ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
cs AS (SELECT *, round(abs(m1 - m0) / sd, 9) AS mp, round(abs(v1 - v0) / greatest(sd * sd, 1e-9), 9) AS vp, greatest(mp, vp) AS score
       FROM cw WHERE n0 >= 12 AND n1 >= 12),
cp AS (SELECT *, max(score) OVER (PARTITION BY sensor_id, channel, run ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING) AS peak,
              max(score) OVER (PARTITION BY sensor_id, channel, run ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS earlier FROM cs),
changes AS (SELECT sensor_id, channel, ts AS change_timestamp, CASE WHEN mp >= vp THEN 'MEAN_SHIFT' ELSE 'VARIANCE_SHIFT' END AS change_type,
    CASE WHEN mp >= vp THEN m0 ELSE v0 END AS before_statistic, CASE WHEN mp >= vp THEN m1 ELSE v1 END AS after_statistic,
    CASE WHEN mp >= vp THEN m1 - m0 ELSE v1 - v0 END AS magnitude, mp AS standardized_magnitude,
    CAST(row_number() OVER (PARTITION BY sensor_id, channel, run ORDER BY score DESC, ts) AS INTEGER) AS rank
  FROM cp WHERE score = peak AND (earlier IS NULL OR earlier < score) AND 24 * score * score / 2 >= 2.0 * ln(n))"""


def changes(obs):
    return N.change_points(provided(obs), HOURLY, window_rows=24, least_days=3, penalty=2.0)


@query("change_points", sql(PLONG + CHANGES, "SELECT * FROM changes",
       "before_statistic after_statistic magnitude standardized_magnitude"))
def _(spark, sf):
    return rounded(changes(hourly(spark, sf)))


@query("near_event_join", sql(PLONG + UNIVARIATE + CHANGES, """
SELECT sensor_id, channel, ts, methods FROM cand c WHERE EXISTS (SELECT 1 FROM changes x WHERE x.sensor_id = c.sensor_id
  AND x.channel = c.channel AND abs(date_diff('second', x.change_timestamp, c.ts)) <= 21600)"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    keys = ["sensor_id", "channel"]
    hits = N.near_event_join(candidates(obs), changes(obs), keys, "ts", "change_timestamp")
    return hits.select(*keys, "ts", "methods")


@query("anomaly_consensus", sql(PLONG + UNIVARIATE + CHANGES, """
SELECT sensor_id, city, ts, channel, methods, methods_triggered, CASE
  WHEN methods_triggered >= 2 AND EXISTS (SELECT 1 FROM changes x WHERE x.sensor_id = c.sensor_id AND x.channel = c.channel
       AND abs(date_diff('second', x.change_timestamp, c.ts)) <= 21600) THEN 'PERSISTENT_SHIFT'
  WHEN (SELECT count(DISTINCT sensor_id) FROM cand d WHERE d.city = c.city AND d.ts = c.ts AND d.channel = c.channel) >= 2 THEN 'LIKELY_ENVIRONMENTAL_EVENT'
  WHEN methods_triggered >= 2 AND date_diff('minute', p, ts) > 120 AND date_diff('minute', ts, nx) > 120 THEN 'ISOLATED_SPIKE'
  WHEN (SELECT count(DISTINCT channel) FROM cand d WHERE d.sensor_id = c.sensor_id AND d.ts = c.ts) >= 2 THEN 'MULTIVARIATE_ANOMALY'
  ELSE 'UNCERTAIN' END AS category
FROM (SELECT *, lag(ts) OVER w AS p, lead(ts) OVER w AS nx FROM cand WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)) c"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    found = N.anomaly_consensus(
        candidates(obs), HOURLY, changes(obs), isolation_minutes=120
    )
    return found.select(
        "sensor_id", "city", "ts", "channel", "methods", "methods_triggered", "category"
    )


DECOMP = """,
bothfill AS (
  SELECT sensor_id, channel, ts, value FROM present UNION ALL
  SELECT sensor_id, channel, ts + to_hours(i), CASE WHEN nts IS NULL THEN value ELSE value + (nv - value) * i / steps END
  FROM (SELECT *, unnest(range(1, 1 + CASE WHEN nts IS NULL THEN least(2, steps) ELSE steps - 1 END)) AS i FROM span)
  WHERE nts IS NULL OR i <= 2 OR i > steps - 1 - 2
  UNION ALL
  SELECT sensor_id, channel, t0 - to_hours(i), v0 FROM (
    SELECT sensor_id, channel, t0, v0, unnest(range(1, 1 + least(2, date_diff('hour', s0, t0)))) AS i
    FROM (SELECT sensor_id, channel, min(ts) AS t0, arg_min(value, ts) AS v0 FROM present GROUP BY ALL)
    JOIN (SELECT sensor_id, min(ts) AS s0 FROM obs GROUP BY ALL) USING (sensor_id))),
okrate AS (SELECT sensor_id, channel FROM (SELECT sensor_id, channel, count(value) AS p FROM plong GROUP BY ALL)
   JOIN (SELECT sensor_id, date_diff('hour', min(ts), max(ts)) + 1 AS g FROM obs GROUP BY ALL) USING (sensor_id) WHERE 1 - p / g <= 0.08 AND g >= 168),
d0 AS (SELECT b.*, CASE WHEN ts = lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM bothfill b SEMI JOIN okrate USING (sensor_id, channel)
       WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
d1 AS (SELECT *, sum(o) OVER (PARTITION BY sensor_id, channel ORDER BY ts) AS run FROM d0),
d2 AS (SELECT *, count(*) OVER (PARTITION BY sensor_id, channel, run) AS len FROM d1),
d3 AS (SELECT * FROM d2 WHERE len >= 168 QUALIFY rank() OVER (PARTITION BY sensor_id, channel ORDER BY len DESC, run) = 1),
d4 AS (SELECT *, CASE WHEN count(*) OVER w = 25 THEN avg(value) OVER w END AS trend FROM d3
       WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
d5 AS (SELECT *, avg(value - trend) OVER (PARTITION BY sensor_id, channel, hour(ts)) AS p FROM d4 WHERE trend IS NOT NULL),
ph AS (SELECT sensor_id, channel, avg(p) AS c FROM (SELECT DISTINCT sensor_id, channel, hour(ts) AS h, round(p, 12) AS p FROM d5) GROUP BY ALL),
comp AS (SELECT sensor_id, channel, ts, value AS observed, trend, p - c AS seasonal, value - trend - (p - c) AS residual
         FROM d5 JOIN ph USING (sensor_id, channel))"""


def components(obs):
    return N.seasonal_components(provided(obs), HOURLY, period=24)


@query("seasonal_decompose", sql(PLONG + FILLED + DECOMP, "SELECT * FROM comp", "observed trend seasonal residual"))
def _(spark, sf):
    return rounded(components(hourly(spark, sf)))


@query("seasonal_strength", sql(PLONG + FILLED + DECOMP, """
SELECT sensor_id, channel, count(*) AS n, greatest(0, 1 - var_pop(residual) / var_pop(residual + seasonal)) AS seasonal_strength,
       greatest(0, 1 - var_pop(residual) / var_pop(residual + trend)) AS trend_strength FROM comp GROUP BY ALL""",
    "seasonal_strength trend_strength"))
def _(spark, sf):
    return rounded(N.seasonal_strength(components(hourly(spark, sf)), ["sensor_id", "channel"]))


@query("isolation_forest")
def _(spark, sf):
    return N.isolation_forest(hourly(spark, sf), HOURLY, CHANNELS)


@query("serve_filtered", sql(OBS, """
SELECT sensor_id, city, ts, pm25, temperature FROM obs WHERE lower(city) = 'east' AND ts BETWEEN '2024-01-05' AND '2024-01-20'""",
    "pm25 temperature"))
def _(spark, sf):
    span = {"start": "2024-01-05", "end": "2024-01-20"}
    # The raw bounds reach the scan; the exact ones follow the aggregate.
    rows = V.serve_filtered(observations(spark, sf, **span), city="EAST", **span)
    return rounded(rows.select("sensor_id", "city", "ts", "pm25", "temperature"))


@query("top_n", sql(READINGS, """
SELECT sensor_id, ts, value FROM readings ORDER BY value DESC, event_id LIMIT 50"""))
def _(spark, sf):
    rows = V.top_n(readings(spark, sf), 50, F.col("value").desc(), F.col("event_id"))
    return rows.select("sensor_id", "ts", "value")


@query("top_per_group", sql(READINGS, """
SELECT sensor_id, ts, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY value DESC, event_id)::INT AS rank FROM readings) WHERE rank <= 5"""))
def _(spark, sf):
    rows = V.top_per_group(
        readings(spark, sf), ["sensor_id"], 5, F.col("value").desc(), F.col("event_id")
    )
    return rows.select("sensor_id", "ts", "value", "rank")


@query("page", sql(READINGS, """
SELECT sensor_id, ts, value, (SELECT count(*) FROM readings) AS total FROM readings ORDER BY ts, event_id LIMIT 100 OFFSET 200"""))
def _(spark, sf):
    total, rows = V.page(readings(spark, sf), [F.col("ts"), F.col("event_id")], 200, 100)
    return rows.select("sensor_id", "ts", "value", F.lit(total).alias("total"))


@query("rolling_view", sql(READINGS, """,
w AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, event_id) - 1 AS o, count(*) OVER (PARTITION BY sensor_id) AS n,
        sensor_id, value, count(value) OVER f AS c, avg(value) OVER f AS m, quantile_cont(value, 0.5) OVER f AS md, min(value) OVER f AS mn, max(value) OVER f AS mx
      FROM readings WINDOW f AS (PARTITION BY sensor_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW))
SELECT sensor_id, ts, value AS raw, CASE WHEN c >= 2 THEN m END AS mean, CASE WHEN c >= 2 THEN md END AS median,
       CASE WHEN c >= 2 THEN mn END AS min, CASE WHEN c >= 2 THEN mx END AS max
FROM w WHERE o % greatest(1, CAST(ceil(n / 1200.0) AS BIGINT)) = 0""", "raw mean:8 median min max"))
def _(spark, sf):
    stats = ["mean", "median", "min", "max", "count"]
    rows = readings(spark, sf)
    blocks = S.fit_blocks(rows, RAW)
    rolled = S.backward_rolling(
        rows, blocks, {s: ("value", 360, s) for s in stats}, segment=None
    ).drop("_us")
    enough = F.col("count") >= 2
    view = S.stride_sample(rolled, blocks, 1200).select(
        "sensor_id", "ts", F.col("value").alias("raw"),
        *[F.when(enough, F.col(s)).alias(s) for s in stats[:-1]],
    )
    return rounded(view, mean=8)


@query("tail_context", sql(OBS, """,
h AS (SELECT sensor_id, ts, pm25 FROM obs WHERE ts < '2024-01-20' QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY ts DESC) <= 24)
SELECT sensor_id, ts, pm25, true AS is_context FROM h UNION ALL SELECT sensor_id, ts, pm25, false FROM obs WHERE ts >= '2024-01-20'""", "pm25"))
def _(spark, sf):
    obs = observations(spark, sf).select("sensor_id", "ts", "pm25")
    start = F.lit("2024-01-20").cast("timestamp_ntz")
    return rounded(V.tail_context(
        obs.where(F.col("ts") < start), obs.where(F.col("ts") >= start), ["sensor_id"], "ts", 24
    ))


@query("sequence_windows", sql(OBS, """,
w AS (SELECT sensor_id, ts, list(pm25) OVER f AS pm25_window, count(*) OVER f AS n, min(ts) OVER f AS a FROM obs
      WINDOW f AS (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT sensor_id, ts, array_to_string([printf('%.4f', floor(x * 100) / 100) for x in pm25_window], ' ') AS pm25_window
FROM w WHERE n = 12 AND ts = a + INTERVAL 11 HOUR"""))
def _(spark, sf):
    from sensorloom.operators.sequences import sequence_windows

    rows = sequence_windows(S.segment_series(observations(spark, sf), HOURLY), HOURLY, ["pm25"], 12)
    text = F.array_join(
        F.transform("window", lambda x: F.format_string("%.4f", F.floor(x["pm25"] * 100) / 100)), " "
    )
    return rows.select("sensor_id", "ts", text.alias("pm25_window"))


@query("anomaly_count_lookup", sql(PLONG + UNIVARIATE, """
SELECT o.sensor_id, o.ts, coalesce(n, 0) AS anomaly_count FROM obs o
LEFT JOIN (SELECT sensor_id, ts, count(*) AS n FROM cand WHERE methods_triggered >= 2 GROUP BY ALL) a ON a.sensor_id = o.sensor_id AND a.ts = o.ts"""))
def _(spark, sf):
    from sensorloom.operators.features import anomaly_count_lookup

    obs = hourly(spark, sf)
    rows = anomaly_count_lookup(obs, candidates(obs), HOURLY)
    return rows.select("sensor_id", "ts", "anomaly_count")
