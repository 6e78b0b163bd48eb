"""Queries over completeness, events and quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import audit as A
from sensorloom.operators import quality as Q
from sensorloom.operators.series import fit_blocks, to_long
from sensorloom.plans.network import (
    CHANNELS, HOURLY, LONG, OBS, RAW, READINGS, USERS, hourly, observations, query_table, readings,
    rounded, sql, user_readings,
)
from sensorloom.sources.staging import stage

QUERIES, SQL, query = query_table()

IDS = ["sensor_id", "city", "ts"]


def long(obs):
    return to_long(obs, IDS, CHANNELS)


def provided(obs):
    return A.provided_long(obs, HOURLY, CHANNELS, IDS)


def gaps(obs):
    return A.gap_events(obs, HOURLY)


def flatlines(obs, cells=None):
    """Hourly series are short of long flat runs, so the minimum is two here."""
    return Q.flatline_runs(provided(obs) if cells is None else cells, HOURLY, minimum=2)


def jumps(obs, cells=None):
    return Q.jump_events(provided(obs) if cells is None else cells, HOURLY)


def drifts(obs, cells=None):
    """Sample minima scale with the cadence: one reading per hour, not four."""
    return Q.drift_runs(
        provided(obs) if cells is None else cells, HOURLY, short_minimum=12, baseline_minimum=48, run_minimum=3
    )


PLONG = LONG + """,
plong AS (SELECT long.* FROM long JOIN provided USING (sensor_id, channel))"""

GAPS = """,
stepped AS (SELECT sensor_id, ts, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS pts
            FROM (SELECT DISTINCT sensor_id, ts FROM obs)),
steps AS (SELECT sensor_id, pts, ts, date_diff('microsecond', pts, ts) / 1e6 AS seconds
          FROM stepped WHERE pts IS NOT NULL),
modes AS (SELECT sensor_id, arg_max(s, (c, -s)) AS mode_seconds
          FROM (SELECT sensor_id, round(seconds, 3) AS s, count(*) AS c FROM steps GROUP BY ALL) GROUP BY ALL),
expected AS (SELECT sensor_id, mode_seconds, median_seconds,
                    CASE WHEN mode_seconds > 0 THEN mode_seconds ELSE median_seconds END AS e
             FROM modes JOIN (SELECT sensor_id, quantile_cont(seconds, 0.5) AS median_seconds FROM steps GROUP BY ALL)
             USING (sensor_id)),
gaps AS (SELECT *, CASE WHEN missing_readings <= 0 THEN 'NORMAL' WHEN missing_readings = 1 THEN 'MINOR'
                        WHEN missing_readings <= 4 THEN 'MODERATE'
                        WHEN duration_seconds < 86400 AND missing_readings < greatest(96, floor(86400 / e)) THEN 'MAJOR'
                        ELSE 'CRITICAL' END AS severity
         FROM (SELECT sensor_id, pts AS gap_start, ts AS gap_end, seconds AS duration_seconds,
                      seconds / 3600 AS duration_hours, e,
                      greatest(0, CAST(round_even(seconds / e, 0) AS BIGINT) - 1) AS missing_readings
               FROM steps JOIN expected USING (sensor_id) WHERE seconds > 1.5 * e))"""


@query("channel_availability", sql(LONG, """
SELECT sensor_id, channel, count(*) AS readings, count(value) AS present,
       CASE WHEN count(value) = 0 THEN 'STRUCTURALLY_UNAVAILABLE'
            WHEN count(value) < count(*) THEN 'PARTIALLY_MISSING' ELSE 'AVAILABLE' END AS status
FROM long GROUP BY ALL"""))
def _(spark, sf):
    return A.channel_availability(observations(spark, sf), HOURLY, CHANNELS)


@query("gap_events", sql(OBS + GAPS, "SELECT * EXCLUDE (e) FROM gaps", "duration_hours"))
def _(spark, sf):
    return rounded(gaps(hourly(spark, sf)))


@query("sampling_profile", sql(OBS + GAPS, """
SELECT sensor_id, any_value(median_seconds) AS median_seconds, any_value(mode_seconds) AS mode_seconds,
       any_value(mn) AS min_seconds, any_value(mx) AS max_seconds, any_value(e) / 60 AS expected_minutes,
       count(gap_start) AS gap_count, coalesce(sum(missing_readings), 0)::BIGINT AS missing_readings,
       count(*) FILTER (severity IN ('MAJOR', 'CRITICAL')) AS major_gap_count,
       coalesce(max(duration_hours), 0) AS longest_gap_hours
FROM expected e1 JOIN (SELECT sensor_id, min(seconds) AS mn, max(seconds) AS mx FROM steps GROUP BY ALL) USING (sensor_id)
LEFT JOIN (SELECT * EXCLUDE (e) FROM gaps) USING (sensor_id) GROUP BY sensor_id"""))
def _(spark, sf):
    return rounded(A.sampling_profile(hourly(spark, sf), HOURLY))


@query("interval_histogram", sql(OBS + GAPS, """
SELECT sensor_id, round(seconds, 3) / 60 AS minutes, count(*) AS readings FROM steps GROUP BY ALL"""))
def _(spark, sf):
    return A.interval_histogram(observations(spark, sf), HOURLY)


@query("interval_histogram_raw", sql(READINGS, """,
steps AS (SELECT sensor_id, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS pts, ts
          FROM (SELECT DISTINCT sensor_id, ts FROM readings))
SELECT sensor_id, date_diff('microsecond', pts, ts) // 60000000 AS minutes, count(*) AS readings
FROM steps WHERE pts IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    rows = readings(spark, sf)
    steps = A.intervals(rows, fit_blocks(rows, RAW))
    minutes = ((F.col("to_us") - F.col("from_us")) / 60_000_000).cast("long").alias("minutes")
    return steps.groupBy("sensor_id", minutes).agg(F.count(F.lit(1)).alias("readings"))


NULL_RUNS = """,
marked AS (SELECT *, value IS NULL AS absent,
             row_number() OVER (PARTITION BY sensor_id, channel ORDER BY ts)
             - row_number() OVER (PARTITION BY sensor_id, channel, value IS NULL ORDER BY ts) AS island
           FROM long),
nulls AS (SELECT sensor_id, channel, island, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings
          FROM marked WHERE absent GROUP BY ALL)"""


@query("missing_runs", sql(LONG + NULL_RUNS, """
SELECT sensor_id, channel, start_time, end_time, readings FROM nulls"""))
def _(spark, sf):
    return A.missing_runs(long(hourly(spark, sf)), HOURLY)


@query("missing_periods", sql(LONG + NULL_RUNS + GAPS, """
SELECT sensor_id, channel, start_time, end_time, readings, 'MISSING' AS classification FROM nulls
UNION ALL
SELECT sensor_id, channel, gap_start, gap_end, missing_readings, 'TIME_GAP' FROM gaps JOIN provided USING (sensor_id)"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    runs = A.missing_runs(long(obs), HOURLY).withColumn("classification", F.lit("MISSING"))
    channels = A.provided_channels(obs, HOURLY, CHANNELS)
    return runs.unionByName(A.gap_periods(gaps(obs), channels, HOURLY))


@query("missing_summary", sql(LONG + NULL_RUNS, """
SELECT sensor_id, channel, count(*) FILTER (value IS NULL) AS missing_count,
       100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*) AS missing_percentage,
       coalesce(any_value(longest), 0) AS longest_run,
       CASE WHEN count(value) = 0 THEN 'STRUCTURALLY_UNAVAILABLE'
            WHEN count(*) > count(value) AND any_value(longest) = 1 THEN 'RANDOM_MISSING'
            WHEN count(*) > count(value) THEN 'UNKNOWN_MISSING' ELSE 'NONE' END AS classification
FROM long LEFT JOIN (SELECT sensor_id, channel, max(readings) AS longest FROM nulls GROUP BY ALL)
USING (sensor_id, channel) GROUP BY sensor_id, channel""", "missing_percentage"))
def _(spark, sf):
    return rounded(A.missing_summary(long(hourly(spark, sf)), HOURLY))


@query("missing_by_city", sql(LONG, """
SELECT city, channel, count(*) FILTER (value IS NULL) AS missing_count,
       100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*) AS missing_percentage
FROM long GROUP BY ALL""", "missing_percentage"))
def _(spark, sf):
    return rounded(A.missing_by(observations(spark, sf), ["city"], CHANNELS))


@query("missing_by_column", sql(LONG, """
SELECT channel, count(*) FILTER (value IS NULL) AS missing_count,
       100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*) AS missing_percentage
FROM long GROUP BY ALL""", "missing_percentage"))
def _(spark, sf):
    return rounded(A.missing_by(observations(spark, sf), [], CHANNELS))


@query("duplicate_audit", sql(READINGS, """,
r AS (SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts, event_type AS kind, value FROM readings),
f AS (SELECT count(*) AS c FROM r GROUP BY sensor_id, ts, kind, value),
t AS (SELECT count(*) AS c FROM r GROUP BY ts),
k AS (SELECT count(*) AS c FROM r GROUP BY sensor_id, ts),
m AS (SELECT count(*) AS c FROM r GROUP BY sensor_id, ts, value)
SELECT (SELECT sum(c - 1) FROM f)::BIGINT AS full_duplicate_rows,
       (SELECT coalesce(sum(c), 0) FROM f WHERE c > 1)::BIGINT AS full_duplicate_rows_in_groups,
       (SELECT count(*) FROM t WHERE c > 1) AS shared_timestamps,
       (SELECT coalesce(sum(c), 0) FROM k WHERE c > 1)::BIGINT AS duplicate_timestamp_rows,
       (SELECT count(*) FROM k WHERE c > 1) AS duplicate_timestamp_groups,
       (SELECT coalesce(sum(c), 0) FROM m WHERE c > 1)::BIGINT AS repeated_record_rows"""))
def _(spark, sf):
    hourly = user_readings(spark, sf).select(
        "sensor_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "kind", "value"
    )
    return A.duplicate_audit(hourly, USERS, ["value"])


@query("numeric_audit", sql(LONG, """
SELECT channel, count(value) AS count, count(*) FILTER (value IS NULL) AS missing,
       count(*) FILTER (isinf(value)) AS infinite, count(*) FILTER (value = 0) AS zero_count,
       count(*) FILTER (value < 0) AS negative_count, min(value) AS min, max(value) AS max,
       avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
FROM long GROUP BY ALL""", "min max mean std median p95 p99"))
def _(spark, sf):
    return rounded(A.numeric_audit(long(hourly(spark, sf))))


@query("overview", sql(OBS, """
SELECT count(*) AS row_count, count(DISTINCT city) AS city_count, count(DISTINCT sensor_id) AS sensor_count,
       min(ts) AS earliest, max(ts) AS latest,
       count(*) * 6 - count(pm25) - count(temperature) - count(humidity) - count(no2) - count(o3) - count(aqi) AS missing_cells,
       100.0::DOUBLE * missing_cells / (count(*) * 6) AS missing_percentage,
       date_diff('second', min(ts), max(ts)) / 3600.0::DOUBLE AS duration_hours
FROM obs""", "missing_percentage"))
def _(spark, sf):
    return rounded(A.overview(observations(spark, sf), HOURLY, CHANNELS))


@query("sensors_per_city", sql(READINGS, """
SELECT city, list(DISTINCT sensor_id ORDER BY sensor_id) AS sensors FROM readings GROUP BY ALL"""))
def _(spark, sf):
    return A.sensors_per_city(readings(spark, sf), RAW)


@query("availability_audit", sql(OBS, """,
span AS (SELECT sensor_id, min(ts) AS a, max(ts) AS b, count(*) AS received_readings FROM obs GROUP BY ALL),
grid AS (SELECT sensor_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
absent AS (SELECT sensor_id, count(*) AS missing_timestamps FROM grid ANTI JOIN obs USING (sensor_id, ts) GROUP BY ALL),
sizes AS (SELECT sensor_id, count(*) AS expected_readings FROM grid GROUP BY ALL),
steps AS (SELECT sensor_id, date_diff('second', lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts), ts) / 60 AS m FROM obs),
worst AS (SELECT sensor_id, max(m)::DOUBLE AS largest_gap_minutes, count(*) FILTER (m > 90) AS gaps_over_tolerance,
                 count(*) FILTER (m >= 90) AS major_gaps FROM steps GROUP BY ALL)
SELECT sensor_id, expected_readings, received_readings, coalesce(missing_timestamps, 0) AS missing_timestamps,
       round(100.0::DOUBLE * received_readings / expected_readings, 3) AS received_percent,
       largest_gap_minutes, gaps_over_tolerance, major_gaps
FROM span JOIN sizes USING (sensor_id) LEFT JOIN absent USING (sensor_id) JOIN worst USING (sensor_id)"""))
def _(spark, sf):
    return A.availability_audit(observations(spark, sf), HOURLY)


PLAUSIBLE = """,
fences AS (SELECT sensor_id, channel, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM plong GROUP BY ALL),
plausible AS (
  SELECT sensor_id, city, ts, channel, value,
         CASE WHEN value IS NULL THEN 'MISSING'
              WHEN value < CASE channel WHEN 'temperature' THEN -50 ELSE 0 END
                OR value > CASE channel WHEN 'temperature' THEN 70 WHEN 'humidity' THEN 100 END
              THEN 'POSSIBLE_SENSOR_ERROR'
              WHEN q3 > q1 AND value > q3 + 4 * (q3 - q1) THEN 'EXTREME'
              WHEN value = 0 AND channel IN ('pm25', 'no2', 'o3') THEN 'SUSPICIOUS' END AS flag
  FROM plong JOIN fences USING (sensor_id, channel))"""


@query("plausibility_flag", sql(PLONG + PLAUSIBLE, """
SELECT sensor_id, city, ts, channel, value, flag FROM plausible WHERE flag IS NOT NULL""", "value"))
def _(spark, sf):
    flags = Q.plausibility_flags(provided(hourly(spark, sf)), HOURLY)
    return rounded(flags.where(F.col("flag").isNotNull()))


JUMPS = """,
moved AS (SELECT *, lag(value) OVER w AS previous_value, abs(value - lag(value) OVER w) AS absolute_change,
                 date_diff('second', lag(ts) OVER w, ts) / 3600.0::DOUBLE AS h
          FROM plong WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
centers AS (SELECT sensor_id, channel, count(absolute_change) AS n, quantile_cont(absolute_change, 0.5) AS med,
                   quantile_cont(absolute_change, 0.25) AS q1, quantile_cont(absolute_change, 0.75) AS q3
            FROM moved GROUP BY ALL),
mads AS (SELECT sensor_id, channel, 1.482602218505602 * quantile_cont(abs(absolute_change - med), 0.5) AS mad
         FROM moved JOIN centers USING (sensor_id, channel) GROUP BY ALL),
jumps AS (SELECT sensor_id, city, ts, channel, value, previous_value, absolute_change,
                 CASE WHEN previous_value <> 0 THEN abs(absolute_change / previous_value) END AS relative_change,
                 CASE WHEN h > 0 THEN absolute_change / h END AS rate_per_hour,
                 greatest(med + 8 * mad, q3 + 3 * (q3 - q1), 1e-12) AS robust_threshold,
                 absolute_change / robust_threshold AS robust_strength
          FROM moved JOIN centers USING (sensor_id, channel) JOIN mads USING (sensor_id, channel)
          WHERE n >= 12 AND absolute_change >= greatest(med + 8 * mad, q3 + 3 * (q3 - q1), 1e-12))"""


@query("jump_events", sql(PLONG + JUMPS, "SELECT * FROM jumps",
       "value previous_value absolute_change relative_change rate_per_hour robust_threshold robust_strength"))
def _(spark, sf):
    return rounded(jumps(hourly(spark, sf)))


FLATS = """,
flat0 AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS opens
          FROM plong WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
flat1 AS (SELECT *, sum(opens) OVER (PARTITION BY sensor_id, channel ORDER BY ts) AS run FROM flat0),
flats AS (SELECT sensor_id, channel, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings,
                 max(value) AS value, date_diff('second', min(ts), max(ts)) / 3600.0::DOUBLE AS duration_hours
          FROM flat1 WHERE value IS NOT NULL GROUP BY sensor_id, channel, run HAVING count(*) >= 2)"""


@query("flatline_runs", sql(PLONG + FLATS, "SELECT * FROM flats", "value"))
def _(spark, sf):
    return rounded(flatlines(hourly(spark, sf)))


@query("low_variance_runs", sql(PLONG, """,
tol AS (SELECT sensor_id, channel, greatest(0.3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 1e-6) AS t
        FROM plong GROUP BY ALL),
rolled AS (SELECT sensor_id, channel, ts, coalesce(count(value) OVER w = 3 AND stddev_samp(value) OVER w <= t, false) AS near
           FROM plong JOIN tol USING (sensor_id, channel)
           WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
marked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY ts)
             - row_number() OVER (PARTITION BY sensor_id, channel, near ORDER BY ts) AS island FROM rolled)
SELECT sensor_id, channel, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings,
       date_diff('second', min(ts), max(ts)) / 3600.0::DOUBLE AS duration_hours
FROM marked WHERE near GROUP BY sensor_id, channel, island HAVING count(*) >= 6"""))
def _(spark, sf):
    return Q.low_variance_runs(provided(hourly(spark, sf)), HOURLY, k=3, iqr_share=0.3)


DRIFTS = """,
rolled AS (SELECT sensor_id, channel, ts, value,
             CASE WHEN count(value) OVER s >= 12 THEN quantile_cont(value, 0.5) OVER s END
             - CASE WHEN count(value) OVER b >= 48 THEN quantile_cont(value, 0.5) OVER b END AS delta
           FROM (SELECT * FROM plong WHERE value IS NOT NULL)
           WINDOW s AS (PARTITION BY sensor_id, channel ORDER BY ts
                        RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY sensor_id, channel ORDER BY ts
                        RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW)),
dmed AS (SELECT sensor_id, channel, quantile_cont(delta, 0.5) AS med, count(delta) AS n, count(*) AS total
         FROM rolled GROUP BY ALL),
dmad AS (SELECT sensor_id, channel, 1.482602218505602 * quantile_cont(abs(delta - med), 0.5) AS mad,
                any_value(n) AS n, any_value(total) AS total
         FROM rolled JOIN dmed USING (sensor_id, channel) GROUP BY ALL),
out AS (SELECT sensor_id, channel, ts, delta, coalesce(abs(delta) > 3 * mad, false) AS off
        FROM rolled JOIN dmad USING (sensor_id, channel) WHERE mad > 0 AND n >= 12 AND total >= 48),
marked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY ts)
             - row_number() OVER (PARTITION BY sensor_id, channel, off ORDER BY ts) AS island FROM out),
drifts AS (SELECT sensor_id, channel, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings,
                  date_diff('second', min(ts), max(ts)) / 3600.0::DOUBLE AS duration_hours,
                  quantile_cont(delta, 0.5) AS magnitude
           FROM marked WHERE off GROUP BY sensor_id, channel, island HAVING count(*) >= 3)"""


@query("drift_runs", sql(PLONG + DRIFTS, "SELECT * FROM drifts", "magnitude"))
def _(spark, sf):
    return rounded(drifts(hourly(spark, sf)))


@query("flag_by_interval", sql(PLONG + FLATS, """
SELECT sensor_id, ts, EXISTS (SELECT 1 FROM flats f WHERE f.sensor_id = o.sensor_id
                              AND o.ts BETWEEN f.start_time AND f.end_time) AS flatline_flag FROM obs o"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    return Q.flag_by_interval(
        obs.select("sensor_id", "ts"), flatlines(obs), HOURLY, "flatline_flag"
    )


@query("flag_by_key", sql(OBS + GAPS, """
SELECT sensor_id, ts, (sensor_id, ts) IN (SELECT (sensor_id, gap_end) FROM gaps) AS sampling_gap_flag FROM obs"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    ends = gaps(obs).select("sensor_id", F.col("gap_end").alias("ts"))
    keys = ["sensor_id", "ts"]
    return Q.flag_by_key(obs.select(*keys), ends, keys, "sampling_gap_flag")


FLAGGED = PLONG + GAPS + PLAUSIBLE + JUMPS + FLATS + DRIFTS + """,
vals AS (SELECT sensor_id, ts, bool_or(coalesce(flag = 'MISSING', false)) AS missing_flag,
                bool_or(coalesce(flag <> 'MISSING', false)) AS suspicious_value_flag FROM plausible GROUP BY ALL),
flags AS (
  SELECT o.sensor_id, o.ts, coalesce(missing_flag, false) AS missing_flag,
         coalesce(suspicious_value_flag, false) AS suspicious_value_flag,
         EXISTS (SELECT 1 FROM gaps g WHERE g.sensor_id = o.sensor_id AND g.gap_end = o.ts) AS sampling_gap_flag,
         EXISTS (SELECT 1 FROM jumps j WHERE j.sensor_id = o.sensor_id AND j.ts = o.ts) AS jump_flag,
         EXISTS (SELECT 1 FROM flats f WHERE f.sensor_id = o.sensor_id AND o.ts BETWEEN f.start_time AND f.end_time) AS flatline_flag,
         EXISTS (SELECT 1 FROM drifts d WHERE d.sensor_id = o.sensor_id AND o.ts BETWEEN d.start_time AND d.end_time) AS possible_drift_flag
  FROM obs o LEFT JOIN vals USING (sensor_id, ts)),
cleaned AS (
  SELECT *, CASE WHEN suspicious_value_flag OR jump_flag THEN 'SUSPICIOUS'
                 WHEN flatline_flag THEN 'POSSIBLE_STUCK_PATTERN' WHEN possible_drift_flag THEN 'POSSIBLE_DRIFT'
                 WHEN sampling_gap_flag THEN 'GAP' WHEN missing_flag THEN 'MISSING_OR_UNAVAILABLE'
                 ELSE 'NORMAL' END AS overall_quality_flag FROM flags)"""


def cleaned(obs):
    # Read by every detector, some of them in several passes.
    cells = stage(provided(obs))
    return Q.flag_rows(
        obs, HOURLY, cells, gaps(obs), jumps(obs, cells), flatlines(obs, cells), drifts(obs, cells)
    )


@query("overall_quality_flag", sql(FLAGGED, "SELECT * FROM cleaned"))
def _(spark, sf):
    rows = cleaned(hourly(spark, sf))
    return rows.select("sensor_id", "ts", *[c for c in rows.columns if c.endswith("_flag")])


@query("sensor_quality_summary", sql(PLONG + GAPS + JUMPS + FLATS + DRIFTS, """,
base AS (
  SELECT s.sensor_id, readings, missing_rate,
    coalesce((SELECT max(duration_hours) FROM gaps g WHERE g.sensor_id = s.sensor_id), 0) AS longest_gap_hours,
    (SELECT count(*) FROM gaps g WHERE g.sensor_id = s.sensor_id) AS gap_count,
    (SELECT count(*) FROM flats g WHERE g.sensor_id = s.sensor_id) AS flatline_events,
    (SELECT count(*) FROM jumps g WHERE g.sensor_id = s.sensor_id) AS jump_count,
    (SELECT count(*) FROM drifts g WHERE g.sensor_id = s.sensor_id) AS drift_periods
  FROM (SELECT sensor_id, count(*) AS readings FROM obs GROUP BY ALL) s
  JOIN (SELECT sensor_id, 100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*) AS missing_rate FROM plong GROUP BY ALL) m
  USING (sensor_id))
SELECT *,
  CASE WHEN longest_gap_hours >= 24 OR drift_periods > 0 OR flatline_events > 0 THEN
    array_to_string(list_filter([CASE WHEN longest_gap_hours >= 24 THEN 'Poor Availability' END,
      CASE WHEN drift_periods > 0 THEN 'Possible Drift' END,
      CASE WHEN flatline_events > 0 THEN 'Possible Stuck Pattern' END], lambda x: x IS NOT NULL), '; ')
    WHEN jump_count > 0 OR missing_rate > 1 THEN 'Needs Review' ELSE 'Healthy-looking' END AS statuses,
  coalesce(nullif(concat_ws(' ',
    CASE WHEN longest_gap_hours >= 24 THEN printf('gap of %.1f h', longest_gap_hours) END,
    CASE WHEN drift_periods > 0 THEN printf('drift runs: %d', drift_periods) END,
    CASE WHEN flatline_events > 0 THEN printf('flat runs: %d', flatline_events) END,
    CASE WHEN jump_count > 0 THEN printf('jumps: %d', jump_count) END), ''), 'nothing found') AS explanation
FROM base""", "missing_rate"))
def _(spark, sf):
    obs = hourly(spark, sf)
    cells = stage(provided(obs))
    out = Q.sensor_quality_summary(
        obs, HOURLY, cells, A.sampling_profile(obs, HOURLY), flatlines(obs, cells), jumps(obs, cells),
        drifts(obs, cells),
    )
    return rounded(out.withColumn("statuses", F.array_join("statuses", "; ")))


@query("flag_counts", sql(FLAGGED, """
SELECT sensor_id, overall_quality_flag, count(*) AS readings FROM cleaned GROUP BY ALL"""))
def _(spark, sf):
    return cleaned(hourly(spark, sf)).groupBy("sensor_id", "overall_quality_flag").agg(
        F.count(F.lit(1)).alias("readings")
    )


@query("gap_severity", sql(OBS + GAPS, """
SELECT sensor_id, severity, count(*) AS gaps, sum(missing_readings)::BIGINT AS missing_readings FROM gaps GROUP BY ALL"""))
def _(spark, sf):
    return gaps(hourly(spark, sf)).groupBy("sensor_id", "severity").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("missing_readings").alias("missing_readings")
    )
