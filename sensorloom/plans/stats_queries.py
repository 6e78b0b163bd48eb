"""Queries over distributions, profiles and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, robust_scale
from sensorloom.functions.rows import single_row
from sensorloom.operators import relations as R
from sensorloom.operators import stats as T
from sensorloom.operators.pairs import group_agreement
from sensorloom.operators.quality import MAD_ROUNDED
from sensorloom.operators.series import to_long
from sensorloom.plans.audit_queries import PLONG, long, provided
from sensorloom.plans.network import (
    CHANNELS, HOURLY, LONG, OBS, READINGS, hourly, query_table, readings, rounded, sql,
)
from sensorloom.sources.staging import stage

QUERIES, SQL, query = query_table()

GROUPS = ["sensor_id", "channel"]
SCOPED = LONG + """,
scoped AS (
  SELECT 'global' AS scope_type, 'All sensors' AS scope_value, * FROM long UNION ALL
  SELECT 'city', city, * FROM long UNION ALL SELECT 'sensor', sensor_id, * FROM long)"""
STATS_COLS = ("mean variance std min max skewness kurtosis p01 p05 p10 p25 p50 p75 p90 p95 p99 iqr "
              "coefficient_of_variation")


def scoped_long(obs):
    return T.with_scopes(long(obs), T.standard_scopes())


@query("descriptive_stats", sql(SCOPED, """
SELECT scope_type, scope_value, channel, count(value) AS count, avg(value) AS mean, var_samp(value) AS variance,
       coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max,
       skewness(value) AS skewness, kurtosis(value) AS kurtosis,
       quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.1) AS p10,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
       quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
       CASE WHEN avg(value) <> 0 THEN coalesce(stddev_samp(value), 0) / abs(avg(value)) END AS coefficient_of_variation
FROM scoped GROUP BY scope_type, scope_value, channel HAVING count(value) > 0""", STATS_COLS))
def _(spark, sf):
    return rounded(
        T.descriptive_stats(scoped_long(hourly(spark, sf)), ["scope_type", "scope_value", "channel"])
    )


@query("descriptive_stats_raw", sql(READINGS, """
SELECT sensor_id, count(value) AS count, avg(value) AS mean, var_samp(value) AS variance,
       stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
       skewness(value) AS skewness, kurtosis(value) AS kurtosis,
       quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.1) AS p10,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
       quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
       stddev_samp(value) / abs(avg(value)) AS coefficient_of_variation
FROM readings GROUP BY sensor_id""", STATS_COLS))
def _(spark, sf):
    return rounded(T.descriptive_stats(readings(spark, sf), ["sensor_id"]))


HIST = """,
span AS (SELECT sensor_id, channel, count(*) AS n, min(value) AS lo0, max(value) AS hi0
         FROM long WHERE value IS NOT NULL GROUP BY ALL),
span2 AS (SELECT sensor_id, channel, n, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                 CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi,
                 least(40, greatest({least}, floor(sqrt(n))::INT)) AS bins FROM span),
bins AS (SELECT sensor_id, channel, lo, hi, bins, n, unnest(range(bins))::INT AS bin FROM span2),
placed AS (SELECT sensor_id, channel, least(floor((value - lo) * bins / (hi - lo)), bins - 1)::INT AS bin, count(*) AS c
           FROM long JOIN span2 USING (sensor_id, channel) WHERE value IS NOT NULL GROUP BY ALL),
hist AS (SELECT sensor_id, channel, bin, bins, n, lo + bin * (hi - lo) / bins AS bin_start,
                lo + (bin + 1) * (hi - lo) / bins AS bin_end, coalesce(c, 0) AS count
         FROM bins LEFT JOIN placed USING (sensor_id, channel, bin))"""


@query("histogram", sql(LONG + HIST.replace("{least}", "10"), """
SELECT sensor_id, channel, bin, bin_start, bin_end, count FROM hist""", "bin_start bin_end"))
def _(spark, sf):
    return rounded(T.histogram(long(hourly(spark, sf)), GROUPS, "value"))


WEIGHTS = ", ".join(
    f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-5, 6), T.smoothing_weights())
)
MODES = HIST.replace("{least}", "12") + f""",
w(k, w) AS (VALUES {WEIGHTS}),
smooth AS (
  SELECT h.sensor_id, h.channel, h.bin, any_value(h.n) AS n, sum(g.count * w ORDER BY k) AS s
  FROM hist h CROSS JOIN w JOIN hist g ON g.sensor_id = h.sensor_id AND g.channel = h.channel
   AND g.bin = CASE WHEN h.bin + k < 0 THEN -(h.bin + k) - 1 WHEN h.bin + k >= h.bins THEN 2 * h.bins - 1 - (h.bin + k) ELSE h.bin + k END
  GROUP BY h.sensor_id, h.channel, h.bin),
tops AS (SELECT sensor_id, channel, greatest(1, 0.08 * max(s)) AS need, any_value(n) AS n FROM smooth GROUP BY ALL),
local AS (SELECT *, lag(s) OVER v AS before, lead(s) OVER v AS after FROM smooth
          WINDOW v AS (PARTITION BY sensor_id, channel ORDER BY bin)),
peaks AS (SELECT l.sensor_id, l.channel, l.bin, l.s,
            coalesce((SELECT max(bin) FROM smooth x WHERE x.sensor_id = l.sensor_id AND x.channel = l.channel AND x.bin < l.bin AND x.s > l.s), -1) AS a,
            coalesce((SELECT min(bin) FROM smooth x WHERE x.sensor_id = l.sensor_id AND x.channel = l.channel AND x.bin > l.bin AND x.s > l.s), 99) AS b
          FROM local l WHERE s > before AND s > after),
prominent AS (SELECT p.sensor_id, p.channel, p.bin FROM peaks p JOIN tops USING (sensor_id, channel)
              WHERE p.s - greatest(
                (SELECT min(s) FROM smooth x WHERE x.sensor_id = p.sensor_id AND x.channel = p.channel AND x.bin > a AND x.bin <= p.bin),
                (SELECT min(s) FROM smooth x WHERE x.sensor_id = p.sensor_id AND x.channel = p.channel AND x.bin < b AND x.bin >= p.bin)) >= need),
modes AS (
  SELECT sensor_id, channel,
         CASE WHEN n < 40 OR d < 5 THEN 1 ELSE greatest(1, (SELECT count(*) FROM prominent p
              WHERE p.sensor_id = tops.sensor_id AND p.channel = tops.channel)) END::INT AS modes
  FROM tops JOIN (SELECT sensor_id, channel, count(DISTINCT value) AS d FROM long GROUP BY ALL) USING (sensor_id, channel))"""


@query("mode_count", sql(LONG + MODES, "SELECT * FROM modes"))
def _(spark, sf):
    return T.mode_count(long(hourly(spark, sf)), GROUPS, "value")


@query("trait_text", sql(LONG + MODES, """,
st AS (SELECT sensor_id, channel, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS sk,
              kurtosis(value) AS ku, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
       FROM long GROUP BY ALL HAVING count(value) > 0),
words AS (SELECT *, concat_ws(', ',
    CASE WHEN abs(sk) >= 1 THEN 'strongly ' || CASE WHEN sk > 0 THEN 'right' ELSE 'left' END || '-skewed'
         WHEN abs(sk) >= 0.5 THEN 'moderately ' || CASE WHEN sk > 0 THEN 'right' ELSE 'left' END || '-skewed' END,
    CASE WHEN ku >= 3 THEN 'heavy-tailed' END,
    CASE WHEN modes >= 2 THEN 'possibly multimodal (' || modes || ' density peaks)' END,
    CASE WHEN std <= greatest(abs(mean) * 0.01, 1e-9) THEN 'low-variance' END) AS w
  FROM st JOIN modes USING (sensor_id, channel))
SELECT sensor_id, channel, upper(channel) || ' is ' || CASE WHEN w = '' THEN 'no strong skew or tail signal' ELSE w END
       || printf('; P95=%.2f, P99=%.2f.', round(p95, 2), round(p99, 2)) AS text FROM words"""))
def _(spark, sf):
    rows = long(hourly(spark, sf))
    stats = T.descriptive_stats(rows, GROUPS).join(T.mode_count(rows, GROUPS, "value"), GROUPS)
    return stats.select(*GROUPS, T.trait_text().alias("text"))


PERIODS = """,
periods AS (
  SELECT sensor_id, channel, value, unnest(['hour', 'day_of_week', 'day_type', 'daily', 'weekly']) AS pattern_type,
         unnest([hour(ts)::VARCHAR, dayname(ts), CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END,
                 strftime(ts, '%Y-%m-%d'),
                 strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')]) AS period
  FROM long WHERE value IS NOT NULL)"""


@query("temporal_profile", sql(LONG + PERIODS, """
SELECT sensor_id, channel, pattern_type, period, favg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       max(value) AS max, count(*) AS count, quantile_cont(value, 0.5) AS median
FROM periods GROUP BY ALL""", "mean std min max median"))
def _(spark, sf):
    return rounded(T.temporal_profile(long(hourly(spark, sf)), HOURLY))


@query("peak_hours", sql(LONG, """,
h AS (SELECT sensor_id, channel, hour(ts)::INT AS h, avg(value) AS m FROM long WHERE value IS NOT NULL GROUP BY ALL)
SELECT sensor_id, channel, arg_max(h, (m, -h)) AS peak_hour, max(m) AS peak_mean, arg_min(h, (m, h)) AS low_hour,
       min(m) AS low_mean FROM h GROUP BY ALL""", "peak_mean low_mean"))
def _(spark, sf):
    return rounded(T.peak_hours(long(hourly(spark, sf)), HOURLY))


@query("rolling_summary", sql(LONG, """,
hours AS (SELECT unnest([1, 3, 6, 12, 24])::INT AS window_hours),
vals AS (SELECT sensor_id, channel, ts, value FROM long WHERE value IS NOT NULL),
rolled AS (
  SELECT a.sensor_id, a.channel, a.ts, window_hours, count(*) AS n, avg(b.value) AS mean, quantile_cont(b.value, 0.5) AS median,
         stddev_samp(b.value) AS std, var_samp(b.value) AS var, min(b.value) AS mn, max(b.value) AS mx
  FROM vals a CROSS JOIN hours JOIN vals b ON a.sensor_id = b.sensor_id AND a.channel = b.channel
   AND b.ts <= a.ts AND b.ts > a.ts - to_hours(window_hours) GROUP BY ALL),
ok AS (SELECT sensor_id, channel, ts, window_hours, CASE WHEN n >= 2 THEN mean END AS mean, CASE WHEN n >= 2 THEN median END AS median,
              CASE WHEN n >= 2 THEN std END AS std, CASE WHEN n >= 2 THEN var END AS var,
              CASE WHEN n >= 2 THEN mn END AS mn, CASE WHEN n >= 2 THEN mx END AS mx FROM rolled),
latest AS (SELECT sensor_id, channel, window_hours, mean AS mean_latest, median AS median_latest FROM ok
           QUALIFY row_number() OVER (PARTITION BY sensor_id, channel, window_hours ORDER BY ts DESC) = 1)
SELECT sensor_id, channel, window_hours, any_value(mean_latest) AS mean_latest, any_value(median_latest) AS median_latest,
       min(mn) AS min, max(mx) AS max, quantile_cont(std, 0.5) AS std_median, quantile_cont(var, 0.5) AS variance_median,
       quantile_cont(mx - mn, 0.95) AS range_p95
FROM ok JOIN latest USING (sensor_id, channel, window_hours) GROUP BY ALL""",
    "mean_latest median_latest min max std_median variance_median range_p95"))
def _(spark, sf):
    out = T.rolling_summary(long(hourly(spark, sf)), HOURLY)
    # max_by skips rows without a statistic, so the latest row is taken as it is.
    return rounded(out)


@query("ecdf", sql(READINGS, """,
r AS (SELECT sensor_id, value, row_number() OVER (PARTITION BY sensor_id ORDER BY value) - 1 AS i,
             count(*) OVER (PARTITION BY sensor_id) AS n FROM readings),
k AS (SELECT *, greatest(1, n // 800) AS step FROM r)
SELECT sensor_id, value AS x, (i // step + 1) / ((n - 1) // step + 1) AS y FROM k WHERE i % step = 0""", "x y"))
def _(spark, sf):
    return rounded(T.ecdf(readings(spark, sf), ["sensor_id"], "value"))


@query("kde", sql(READINGS, """,
m AS (SELECT sensor_id, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h,
             quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM readings GROUP BY ALL
      HAVING count(*) >= 20 AND count(DISTINCT value) > 2),
g AS (SELECT *, unnest(range(120))::INT AS point FROM m)
SELECT sensor_id, point, any_value(a + (b - a) * (point / 119)) AS x,
       sum(exp(-0.5 * pow((a + (b - a) * (point / 119) - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density
FROM g JOIN readings USING (sensor_id) GROUP BY sensor_id, point""", "x density"))
def _(spark, sf):
    return rounded(T.kde(readings(spark, sf), ["sensor_id"], "value"))


@query("distribution_summary", sql(LONG, """
SELECT sensor_id, channel, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
FROM long GROUP BY ALL HAVING count(value) > 0""", "mean std min max median p95 p99"))
def _(spark, sf):
    return rounded(T.distribution_summary(long(hourly(spark, sf)), GROUPS))


@query("scatter_sample", sql(OBS, """,
n AS (SELECT sensor_id, ts, pm25 AS x, no2 AS y, row_number() OVER (PARTITION BY sensor_id ORDER BY ts) - 1 AS i,
             greatest(1, ceil(count(*) OVER (PARTITION BY sensor_id) / 200)) AS step
      FROM obs WHERE no2 IS NOT NULL AND pm25 IS NOT NULL)
SELECT sensor_id, ts, x, y FROM n WHERE i % step = 0""", "x y"))
def _(spark, sf):
    return rounded(T.scatter_sample(hourly(spark, sf), HOURLY, "pm25", "no2", points=200))


@query("quantization_profile", sql(LONG, """,
d AS (SELECT DISTINCT sensor_id, channel, value FROM long WHERE value IS NOT NULL),
g AS (SELECT sensor_id, channel, value - lag(value) OVER (PARTITION BY sensor_id, channel ORDER BY value) AS inc FROM d)
SELECT sensor_id, channel, count(*) AS distinct_values, min(inc) AS smallest_increment FROM g GROUP BY ALL""", "smallest_increment"))
def _(spark, sf):
    return rounded(T.quantization_profile(long(hourly(spark, sf)), GROUPS))


PAIR_LIST = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1:]]


def pair_sql(scopes: list[tuple[str, str]], picks) -> str:
    parts = [
        f"SELECT '{kind}' AS scope_type, {value} AS scope_value, '{a}' AS channel_a, '{b}' AS channel_b, "
        f"{a} AS x, {b} AS y FROM obs WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for kind, value in scopes
        for a, b in picks
    ]
    return ",\npairs AS (" + "\nUNION ALL ".join(parts) + ")"


SCOPES = [("global", "'All sensors'"), ("city", "city"), ("sensor", "sensor_id")]
RANKED = """,
ranked AS (
  SELECT *, rank() OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b ORDER BY x)
            + (count(*) OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b, x) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b ORDER BY y)
            + (count(*) OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b, y) - 1) / 2 AS ry
  FROM pairs)"""
CORR = """
SELECT scope_type, scope_value, channel_a, channel_b, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman,
       abs(corr(rx, ry)) - abs(corr(x, y)) AS spearman_minus_pearson
FROM ranked GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x) AND min(y) < max(y)"""
PAIR_KEYS = ["scope_type", "scope_value", "channel_a", "channel_b"]


def scoped_pairs(obs, ordered=False, channels=CHANNELS):
    scoped = T.with_scopes(obs, T.standard_scopes())
    return R.channel_pairs(scoped, PAIR_KEYS[:2], channels, ordered)


@query("correlation_table", sql(OBS + pair_sql(SCOPES, PAIR_LIST) + RANKED, CORR,
       "pearson spearman spearman_minus_pearson"))
def _(spark, sf):
    scoped = T.with_scopes(hourly(spark, sf), T.standard_scopes())
    return rounded(R.correlation_table(scoped, PAIR_KEYS[:2], CHANNELS))


@query("pearson_raw", sql(READINGS, """
SELECT sensor_id, count(*) AS n, corr(value, k) AS pearson FROM readings GROUP BY ALL""", "pearson"))
def _(spark, sf):
    rows = readings(spark, sf).select("sensor_id", F.col("value").alias("x"), F.col("k").alias("y"))
    return rounded(R.pearson(rows, ["sensor_id"]))


@query("spearman_raw", sql(READINGS, """,
r AS (SELECT sensor_id, rank() OVER (PARTITION BY sensor_id ORDER BY value) + (count(*) OVER (PARTITION BY sensor_id, value) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY sensor_id ORDER BY k) + (count(*) OVER (PARTITION BY sensor_id, k) - 1) / 2 AS ry FROM readings)
SELECT sensor_id, count(*) AS n, corr(rx, ry) AS spearman FROM r GROUP BY ALL""", "spearman"))
def _(spark, sf):
    rows = readings(spark, sf).select("sensor_id", F.col("value").alias("x"), F.col("k").alias("y"))
    return rounded(R.spearman(rows, ["sensor_id"]))


@query("correlation_matrix_view", sql(OBS + pair_sql(SCOPES[:1], PAIR_LIST), """,
c AS (SELECT channel_a, channel_b, corr(x, y) AS v FROM pairs GROUP BY ALL),
m AS (SELECT * FROM c UNION ALL SELECT channel_b, channel_a, v FROM c
      UNION ALL SELECT unnest(['pm25', 'temperature', 'humidity', 'no2', 'o3', 'aqi']) AS x, x, 1.0)
SELECT channel_a AS channel, """ + ", ".join(f"max(v) FILTER (channel_b = '{c}') AS {c}" for c in CHANNELS)
    + " FROM m GROUP BY ALL", " ".join(CHANNELS)))
def _(spark, sf):
    pairs = R.channel_pairs(hourly(spark, sf), [], CHANNELS)
    table = R.pearson(pairs, ["channel_a", "channel_b"])
    return rounded(R.matrix_view(table, "pearson", CHANNELS))


@query("aqi_relationships", sql(OBS + pair_sql(SCOPES[2:], [("aqi", c) for c in CHANNELS[:5]]) + RANKED, """
SELECT scope_value AS sensor_id, channel_b AS channel, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman
FROM ranked GROUP BY ALL HAVING count(*) >= 3""", "pearson spearman"))
def _(spark, sf):
    pairs = R.channel_pairs(hourly(spark, sf), ["sensor_id"], CHANNELS, first="aqi")
    pairs = pairs.withColumnRenamed("channel_b", "channel")
    keys = ["sensor_id", "channel"]
    both = R.pearson(pairs, keys, 3).join(R.spearman(pairs, keys, 3).drop("n"), keys)
    return rounded(both)


@query("aqi_statistics", sql(OBS, """
SELECT count(aqi) AS count, min(aqi) AS min, max(aqi) AS max, avg(aqi) AS mean, stddev_samp(aqi) AS std,
       quantile_cont(aqi, 0.5) AS median, count(*) FILTER (aqi > 500) AS above_500 FROM obs""", "mean std median min max"))
def _(spark, sf):
    obs = hourly(spark, sf)
    basic = obs.agg(
        F.count("aqi").alias("count"), F.min("aqi").alias("min"), F.max("aqi").alias("max"),
        F.avg("aqi").alias("mean"), F.stddev_samp("aqi").alias("std"),
        F.count_if(F.col("aqi") > 500).alias("above_500"),
    )
    median = exact_quantiles(obs, [], "aqi", {"median": 0.5})
    return rounded(basic.withColumn("median", single_row(median)["median"]))


@query("mutual_information", sql(OBS + pair_sql([SCOPES[0], SCOPES[2]], [
    (a, b) for a in CHANNELS for b in CHANNELS if a != b]) + RANKED, """,
b AS (SELECT scope_type, scope_value, channel_a, channel_b,
             least(7, floor((rx - 0.5) * 8 / count(*) OVER g)) AS bx, least(7, floor((ry - 0.5) * 8 / count(*) OVER g)) AS by_
      FROM ranked WINDOW g AS (PARTITION BY scope_type, scope_value, channel_a, channel_b)),
c AS (SELECT *, count(*) AS c FROM b GROUP BY ALL),
t AS (SELECT scope_type, scope_value, channel_a, channel_b, c, sum(c) OVER g AS n,
             sum(c) OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b, bx) AS cx,
             sum(c) OVER (PARTITION BY scope_type, scope_value, channel_a, channel_b, by_) AS cy
      FROM c WINDOW g AS (PARTITION BY scope_type, scope_value, channel_a, channel_b))
SELECT scope_type, scope_value, channel_a, channel_b, max(n)::BIGINT AS n, sum(c / n * ln(c * n / (cx * cy))) AS mutual_information
FROM t GROUP BY ALL HAVING max(n) >= 100""", "mutual_information"))
def _(spark, sf):
    obs = hourly(spark, sf)
    scopes = {kind: value for kind, value in T.standard_scopes().items() if kind != "city"}
    pairs = R.channel_pairs(T.with_scopes(obs, scopes), PAIR_KEYS[:2], CHANNELS)
    # The measure is symmetric, so each pair is computed once.
    table = stage(R.mutual_information(pairs, PAIR_KEYS))
    turned = table.select(
        *PAIR_KEYS[:2], F.col("channel_b").alias("channel_a"), F.col("channel_a").alias("channel_b"), "n",
        "mutual_information",
    )
    return rounded(table.unionByName(turned))


LAGS = [60, 120, 180, 360, 720, 1440]


@query("autocorrelation", sql(LONG, """,
lags AS (SELECT unnest([60, 120, 180, 360, 720, 1440])::INT AS lag_minutes)
SELECT a.sensor_id, a.channel, lag_minutes, count(*) AS n, corr(a.value, b.value) AS autocorrelation
FROM long a CROSS JOIN lags JOIN long b ON a.sensor_id = b.sensor_id AND a.channel = b.channel
 AND b.ts = a.ts - to_minutes(lag_minutes)
WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL HAVING count(*) >= 30""", "autocorrelation"))
def _(spark, sf):
    return rounded(R.autocorrelation(hourly(spark, sf), HOURLY, CHANNELS, LAGS))


@query("strongest_lag", sql(LONG, """,
lags AS (SELECT unnest([60, 120, 180, 360, 720, 1440])::INT AS lag_minutes),
c AS (SELECT a.sensor_id, a.channel, lag_minutes, count(*) AS n, round(corr(a.value, b.value), 6) AS autocorrelation
  FROM long a CROSS JOIN lags JOIN long b ON a.sensor_id = b.sensor_id AND a.channel = b.channel
   AND b.ts = a.ts - to_minutes(lag_minutes)
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sensor_id, channel ORDER BY abs(autocorrelation) DESC NULLS LAST, lag_minutes) = 1"""))
def _(spark, sf):
    table = rounded(R.autocorrelation(hourly(spark, sf), HOURLY, CHANNELS, LAGS))
    return R.strongest(table, ["sensor_id", "channel"], "autocorrelation", ["lag_minutes"])


XLAGS = [-360, -180, -120, -60, 0, 60, 120, 180, 360]


@query("cross_correlation", sql(LONG, """,
lags AS (SELECT unnest([-360, -180, -120, -60, 0, 60, 120, 180, 360])::INT AS lag_minutes),
c AS (SELECT * FROM long WHERE value IS NOT NULL)
SELECT a.sensor_id, a.channel AS source, b.channel AS target, lag_minutes, count(*) AS n, corr(a.value, b.value) AS correlation
FROM c a CROSS JOIN lags JOIN c b ON a.sensor_id = b.sensor_id AND a.channel <> b.channel AND b.ts = a.ts + to_minutes(lag_minutes)
GROUP BY ALL HAVING count(*) >= 60""", "correlation"))
def _(spark, sf):
    return rounded(R.cross_correlation(hourly(spark, sf), HOURLY, CHANNELS, XLAGS))


FILLED = """,
present AS (SELECT sensor_id, channel, ts, value, lead(ts) OVER w AS nts, lead(value) OVER w AS nv
            FROM plong WHERE value IS NOT NULL WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
ends AS (SELECT sensor_id, max(ts) AS e FROM obs GROUP BY ALL),
span AS (SELECT *, date_diff('hour', ts, coalesce(nts, e)) AS steps FROM present JOIN ends USING (sensor_id)),
fills AS (SELECT *, unnest(range(1, 1 + CASE WHEN nts IS NULL THEN least(2, steps) ELSE least(2, steps - 1) END)) AS i FROM span),
filled AS (SELECT sensor_id, channel, ts, value, false AS filled FROM present UNION ALL
           SELECT sensor_id, channel, ts + to_hours(i), CASE WHEN nts IS NULL THEN value ELSE value + (nv - value) * i / steps END, true FROM fills)"""


def filled(obs):
    return R.short_gap_interpolate(provided(obs), HOURLY)


@query("short_gap_interpolate", sql(PLONG + FILLED, "SELECT * FROM filled", "value"))
def _(spark, sf):
    return rounded(filled(hourly(spark, sf)).select("sensor_id", "channel", "ts", "value", "filled"))


RUNS = FILLED + """,
r0 AS (SELECT *, CASE WHEN ts = lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM filled
       WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY ts)),
r1 AS (SELECT *, sum(o) OVER (PARTITION BY sensor_id, channel ORDER BY ts) AS run FROM r0),
r2 AS (SELECT *, count(*) OVER (PARTITION BY sensor_id, channel, run) AS run_length FROM r1),
longest AS (SELECT * FROM r2 QUALIFY rank() OVER (PARTITION BY sensor_id, channel ORDER BY run_length DESC, run) = 1)"""


@query("longest_run", sql(PLONG + RUNS, """
SELECT sensor_id, channel, min(ts) AS start_time, max(ts) AS end_time, count(*) AS readings FROM longest GROUP BY ALL"""))
def _(spark, sf):
    return R.longest_run(filled(hourly(spark, sf)), HOURLY).groupBy("sensor_id", "channel").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("readings"),
    )


@query("pacf", "WITH RECURSIVE " + PLONG + RUNS + """,
centred AS (SELECT sensor_id, channel, ts, value - avg(value) OVER (PARTITION BY sensor_id, channel) AS c,
                   count(*) OVER (PARTITION BY sensor_id, channel) AS n FROM longest),
gamma AS (SELECT a.sensor_id, a.channel, any_value(a.n) AS n, k, coalesce(sum(a.c * b.c), 0) AS g
          FROM centred a CROSS JOIN (SELECT unnest(range(0, 25)) AS k)
          LEFT JOIN centred b ON a.sensor_id = b.sensor_id AND a.channel = b.channel AND b.ts = a.ts - to_hours(k) GROUP BY ALL),
rho AS (SELECT sensor_id, channel, any_value(n) AS n, list(g / g0 ORDER BY k) AS r
        FROM gamma JOIN (SELECT sensor_id, channel, g AS g0 FROM gamma WHERE k = 0) USING (sensor_id, channel)
        WHERE k > 0 AND g0 > 0 GROUP BY sensor_id, channel),
dl AS (SELECT sensor_id, channel, n, r, 1 AS lag, [r[1]] AS phi FROM rho UNION ALL
       SELECT sensor_id, channel, n, r, lag + 1,
              list_concat([phi[j] - last * phi[lag + 1 - j] for j in range(1, lag + 1)], [last])
       FROM (SELECT *, (r[lag + 1] - list_sum([phi[j] * r[lag + 1 - j] for j in range(1, lag + 1)]))
                       / (1 - list_sum([phi[j] * r[j] for j in range(1, lag + 1)])) AS last FROM dl WHERE lag < 24))
SELECT sensor_id, channel, n, lag, round(phi[lag], 6) AS pacf FROM dl""")
def _(spark, sf):
    runs = R.longest_run(filled(hourly(spark, sf)), HOURLY)
    return rounded(R.partial_autocorrelation(runs, HOURLY, 24))


SENSOR_PAIRS = """,
sp AS (SELECT DISTINCT a.sensor_id AS sensor_a, b.sensor_id AS sensor_b FROM (SELECT DISTINCT sensor_id, city FROM obs) a
       JOIN (SELECT DISTINCT sensor_id, city FROM obs) b ON a.city = b.city AND a.sensor_id < b.sensor_id),
paired AS (SELECT sensor_a, sensor_b, a.channel, a.ts, a.value AS x, b.value AS y FROM sp
           JOIN long a ON a.sensor_id = sensor_a JOIN long b ON b.sensor_id = sensor_b AND b.channel = a.channel AND b.ts = a.ts
           WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"""


def city_long(obs):
    return to_long(obs, ["city", "sensor_id", "ts"], CHANNELS)


@query("pairwise_sensor_join", sql(LONG + SENSOR_PAIRS, "SELECT * FROM paired", "x y"))
def _(spark, sf):
    # Rounded once a reading instead of once a pair.
    return R.group_pair_join(rounded(city_long(hourly(spark, sf))), "city")


@query("pair_agreement", sql(LONG + SENSOR_PAIRS, """,
r AS (SELECT *, rank() OVER (PARTITION BY sensor_a, sensor_b, channel ORDER BY x) + (count(*) OVER (PARTITION BY sensor_a, sensor_b, channel, x) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY sensor_a, sensor_b, channel ORDER BY y) + (count(*) OVER (PARTITION BY sensor_a, sensor_b, channel, y) - 1) / 2 AS ry
      FROM paired)
SELECT sensor_a, sensor_b, channel, count(*) AS overlap_count, avg(abs(x - y)) AS mae, avg(x - y) AS mean_difference,
       stddev_samp(x - y) AS difference_std, avg(abs(x - y) / nullif((abs(x) + abs(y)) / 2, 0)) AS mean_relative_difference,
       quantile_cont(abs(x - y), 0.5) AS median_absolute_difference, corr(x, y) AS pearson, corr(rx, ry) AS spearman
FROM r GROUP BY ALL""",
    "mae mean_difference difference_std mean_relative_difference median_absolute_difference pearson spearman"))
def _(spark, sf):
    return rounded(group_agreement(city_long(hourly(spark, sf)), "city"))


@query("peer_residual", sql(OBS, """,
big AS (SELECT city FROM obs GROUP BY city HAVING count(DISTINCT sensor_id) >= 3)
SELECT a.sensor_id, a.ts, any_value(a.pm25) AS pm25, quantile_cont(b.pm25, 0.5) AS peer_median,
       any_value(a.pm25) - quantile_cont(b.pm25, 0.5) AS residual
FROM obs a JOIN big USING (city) JOIN obs b ON b.city = a.city AND b.ts = a.ts AND b.sensor_id <> a.sensor_id
GROUP BY a.sensor_id, a.ts""", "pm25 peer_median residual"))
def _(spark, sf):
    out = R.peer_residual(hourly(spark, sf), "city", "pm25")
    return rounded(out.select("sensor_id", "ts", "pm25", "peer_median", "residual"))


@query("channel_pair_join", sql(OBS + pair_sql(SCOPES[2:], PAIR_LIST), """
SELECT scope_value AS sensor_id, channel_a, channel_b, count(*) AS n, sum(x - y) AS total FROM pairs GROUP BY ALL""", "total"))
def _(spark, sf):
    pairs = R.channel_pairs(hourly(spark, sf), ["sensor_id"], CHANNELS)
    return rounded(pairs.groupBy("sensor_id", "channel_a", "channel_b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") - F.col("y")).alias("total")
    ))


@query("robust_scale", sql(LONG, """,
c AS (SELECT sensor_id, channel, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM long GROUP BY ALL HAVING count(value) > 0)
SELECT sensor_id, channel, any_value(median) AS median, 1.4826 * quantile_cont(abs(value - median), 0.5) AS mad, any_value(q1) AS q1,
       any_value(q3) AS q3, any_value(q3 - q1) AS iqr FROM long JOIN c USING (sensor_id, channel) GROUP BY sensor_id, channel""", "median mad q1 q3 iqr"))
def _(spark, sf):
    return rounded(robust_scale(long(hourly(spark, sf)), GROUPS, "value", MAD_ROUNDED))


@query("pearson", sql(OBS + pair_sql(SCOPES[:1], PAIR_LIST), """
SELECT channel_a, channel_b, count(*) AS n, corr(x, y) AS pearson FROM pairs GROUP BY ALL HAVING count(*) >= 30""", "pearson"))
def _(spark, sf):
    pairs = R.channel_pairs(hourly(spark, sf), [], CHANNELS)
    return rounded(R.pearson(pairs, ["channel_a", "channel_b"]))


@query("spearman_matrix", sql(OBS + pair_sql(SCOPES[:1], PAIR_LIST) + RANKED, """
SELECT channel_a, channel_b, count(*) AS n, corr(rx, ry) AS spearman FROM ranked GROUP BY ALL HAVING count(*) >= 30""", "spearman"))
def _(spark, sf):
    return rounded(R.channel_correlations(hourly(spark, sf), [], CHANNELS).drop("pearson"))
