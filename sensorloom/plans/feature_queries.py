"""Queries over features, guideline windows, targets and validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import features as E
from sensorloom.operators import guidelines as G
from sensorloom.operators import series as S
from sensorloom.plans.audit_queries import FLAGGED, cleaned
from sensorloom.plans.network import (
    CHANNELS, HOURLY, OBS, SEG, hourly, observations, query_table, rounded, sql,
)
from sensorloom.sources.staging import stage

QUERIES, SQL, query = query_table()

# Hourly readings: no quarter-hour lag, and one-hour windows would hold one value.
PLAN = E.FeaturePlan(
    lags={"pm25": [60, 180, 360], "temperature": [60, 180], "humidity": [60, 180], "no2": [60, 180]},
    rolling={
        "pm25": {180: ["mean", "median", "std", "min", "max", "range"], 360: ["mean", "std", "cv"]},
        "temperature": {180: ["mean", "std"]},
        "humidity": {180: ["mean", "std"]},
        "no2": {180: ["mean", "std"]},
    },
)
HORIZONS = [60, 180, 360]
GUIDES = [
    G.Guideline("pm25", 15.0, 24, targets=G.WHO_2021[0].targets),
    G.Guideline("no2", 25.0, 24, unit_compatible=False, targets=G.WHO_2021[2].targets),
    G.Guideline("o3", 100.0, 8, cities=("west",), targets=G.WHO_2021[3].targets),
]


def frame(hours: int) -> str:
    return (
        f"(PARTITION BY sensor_id, segment ORDER BY ts RANGE BETWEEN INTERVAL "
        f"'{hours * 3600 - 1}.999999 seconds' PRECEDING AND CURRENT ROW)"
    )


def _roll_sql(channel: str, minutes: int, stat: str) -> str:
    w = f"w{minutes // 60}"
    value = {
        "mean": f"avg({channel}) OVER {w}", "median": f"quantile_cont({channel}, 0.5) OVER {w}",
        "std": f"stddev_samp({channel}) OVER {w}", "min": f"min({channel}) OVER {w}",
        "max": f"max({channel}) OVER {w}", "range": f"max({channel}) OVER {w} - min({channel}) OVER {w}",
        "cv": f"stddev_samp({channel}) OVER {w} / nullif(abs(avg({channel}) OVER {w}), 0)",
    }[stat]
    need = max(2, -(-minutes // 120))
    return f"CASE WHEN count({channel}) OVER {w} >= {need} THEN {value} END"


def _lag_sql(channel: str, minutes: int) -> str:
    return (
        f"max({channel}) OVER (PARTITION BY sensor_id, segment ORDER BY ts RANGE BETWEEN "
        f"INTERVAL {minutes} MINUTE PRECEDING AND INTERVAL {minutes} MINUTE PRECEDING)"
    )


FEATS = """,
feats0 AS (SELECT *, """ + ",\n".join(
    [f"{_lag_sql(c, m)} AS {n}" for n, (c, m) in PLAN.lag_names().items()]
    + [f"{_roll_sql(*spec)} AS {n}" for n, spec in PLAN.rolling_names().items()]
) + f"""
  FROM seg WINDOW w3 AS {frame(3)}, w6 AS {frame(6)}),
feats AS (SELECT *, hour(ts)::INT AS hour, minute(ts)::INT AS minute, (isodow(ts) - 1)::INT AS day_of_week,
  (isodow(ts) >= 6)::INT AS is_weekend, sin(hour(ts) * 2 * pi() / 24) AS sin_hour, cos(hour(ts) * 2 * pi() / 24) AS cos_hour,
  sin((isodow(ts) - 1) * 2 * pi() / 7) AS sin_day_of_week, cos((isodow(ts) - 1) * 2 * pi() / 7) AS cos_day_of_week,
  pm25 - pm25_lag_1h AS pm25_delta_1h, pm25 - pm25_lag_3h AS pm25_delta_3h,
  (pm25 - pm25_lag_1h) / nullif(abs(pm25_lag_1h), 0) AS pm25_pct_change_1h, (pm25 - pm25_lag_3h) / 3.0::DOUBLE AS pm25_slope_3h,
  pm25 * humidity AS pm25_humidity_interaction, temperature * humidity AS temperature_humidity_interaction
  FROM feats0)"""


def segmented(obs):
    return S.segment_series(obs, HOURLY)


def features(obs):
    return E.engineer_features(segmented(obs), HOURLY, PLAN, short_label=None)


FAMILIES = E.feature_families(PLAN, short_label=None)
NUMERIC = list(FAMILIES)


def _family_query(name: str, family: str, ints: str = "") -> None:
    names = [n for n, f in FAMILIES.items() if f == family]
    doubles = " ".join(n for n in names if n not in ints.split())

    @query(name, sql(SEG + FEATS, f"SELECT sensor_id, ts, {', '.join(names)} FROM feats", doubles))
    def _(spark, sf):
        return rounded(features(observations(spark, sf)).select("sensor_id", "ts", *names))


_family_query("calendar_features", "TIME", "hour minute day_of_week is_weekend")
_family_query("rate_features", "RATE_OF_CHANGE")
_family_query("interaction_features", "CROSS_FEATURE")


@query("rolling_features", sql(SEG + FEATS, f"""
SELECT sensor_id, ts, {', '.join(PLAN.lag_names())}, {', '.join(PLAN.rolling_names())} FROM feats""",
    " ".join([*PLAN.lag_names(), *PLAN.rolling_names()])))
def _(spark, sf):
    out = E.series_features(segmented(observations(spark, sf)), HOURLY, PLAN)
    return rounded(out.select("sensor_id", "ts", *PLAN.lag_names(), *PLAN.rolling_names()))


@query("feature_catalog", sql(SEG + FEATS, """
SELECT feature, family, reason, true AS prediction_time_available, 'PASS' AS leakage_check, present,
       round(100.0::DOUBLE * present / n, 6) AS present_percent
FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{f}' AS family, '{E.FAMILY_REASONS[f]}' AS reason, count({n}) AS present, count(*) AS n FROM feats"
    for n, f in FAMILIES.items()) + ")"))
def _(spark, sf):
    return rounded(E.feature_catalog(features(observations(spark, sf)), FAMILIES))


def _guide_sql(g: G.Guideline) -> str:
    p = g.pollutant
    limited = f"city NOT IN ({', '.join(repr(c) for c in g.cities)})" if g.cities else "false"
    absent = limited if g.cities else f"{p} IS NULL"
    ok = f"(cov >= 75 AND average IS NOT NULL AND NOT ({absent}))"
    other = f"CASE WHEN {limited} THEN 'Not Available' ELSE 'Insufficient Data' END"
    if g.unit_compatible:
        steps = " ".join(f"WHEN average <= {top} THEN '{n}'" for n, top in sorted(g.targets.items(), key=lambda i: i[1]))
        status = f"CASE WHEN {ok} THEN CASE WHEN average <= {g.guideline} THEN '{G.MEETS}' ELSE '{G.ABOVE}' END ELSE {other} END"
        level = f"CASE WHEN {ok} THEN CASE WHEN average <= {g.guideline} THEN 'AQG' {steps} ELSE 'Beyond IT-1' END ELSE {other} END"
        exceeded, ratio = f"CASE WHEN {ok} THEN average > {g.guideline} END", f"CASE WHEN {ok} THEN average / {g.guideline} END"
    else:
        status = level = f"CASE WHEN {ok} THEN '{G.UNIT}' ELSE {other} END"
        exceeded, ratio = "NULL::BOOLEAN", "NULL::DOUBLE"
    return f"""SELECT sensor_id, city, ts, '{p}' AS pollutant, '{g.hours}h' AS averaging_period, average, cov AS coverage_percent,
  {g.guideline}::DOUBLE AS guideline, {str(g.unit_compatible).lower()} AS unit_compatible, {status} AS status,
  {exceeded} AS exceeded, {ratio} AS ratio, {level} AS interim_level
FROM (SELECT *, avg({p}) OVER d AS average, least(count({p}) OVER d / {g.hours} * 100, 100) AS cov
      FROM seg WINDOW d AS {frame(g.hours)})"""


WHO = ",\nwho AS (" + "\nUNION ALL ".join(_guide_sql(g) for g in GUIDES) + ")"


def windows(obs):
    return G.who_windows(segmented(obs), HOURLY, GUIDES)


@query("who_windows", sql(SEG + WHO, "SELECT * FROM who", "average:8 coverage_percent ratio:8"))
def _(spark, sf):
    return rounded(windows(observations(spark, sf)), average=8, ratio=8)


@query("who_coverage", sql(SEG + WHO, """
SELECT sensor_id, pollutant, count(*) AS windows, avg(coverage_percent) AS mean_coverage,
       count(*) FILTER (coverage_percent >= 75) AS valid_windows FROM who GROUP BY ALL""", "mean_coverage"))
def _(spark, sf):
    return rounded(G.who_coverage(windows(observations(spark, sf)), ["sensor_id"]))


@query("who_exceedances", sql(SEG + WHO, """
SELECT sensor_id, pollutant, count(exceeded) AS valid_windows, count(*) FILTER (exceeded) AS exceeded_windows,
       100.0::DOUBLE * count(*) FILTER (exceeded) / nullif(count(exceeded), 0) AS exceeded_percent
FROM who GROUP BY ALL""", "exceeded_percent"))
def _(spark, sf):
    return rounded(G.who_exceedances(windows(observations(spark, sf)), ["sensor_id"]))


LATEST = WHO + """,
latest AS (SELECT * FROM who QUALIFY row_number() OVER (PARTITION BY sensor_id, pollutant
           ORDER BY status IN ('Insufficient Data', 'Not Available'), ts DESC) = 1),
supported AS (SELECT * FROM latest WHERE unit_compatible QUALIFY row_number() OVER (PARTITION BY sensor_id
           ORDER BY CASE WHEN status = 'Above WHO Guideline' THEN ratio ELSE -1 END DESC, pollutant) = 1),
overall AS (SELECT l.sensor_id, l.city, coalesce(s.status, 'Insufficient Data') AS overall_status,
                   upper(s.pollutant) AS dominant_pollutant
            FROM (SELECT DISTINCT sensor_id, city FROM latest) l LEFT JOIN supported s USING (sensor_id))"""


@query("latest_status", sql(SEG + LATEST, "SELECT * FROM latest", "average:8 coverage_percent ratio:8"))
def _(spark, sf):
    return rounded(
        G.latest_status(windows(observations(spark, sf)), HOURLY), average=8, ratio=8
    )


@query("overall_status", sql(SEG + LATEST, "SELECT * FROM overall"))
def _(spark, sf):
    return G.overall_status(G.latest_status(windows(observations(spark, sf)), HOURLY), HOURLY)


@query("network_status", sql(SEG + LATEST, """,
worst AS (SELECT sensor_id, max(ratio) AS r FROM latest WHERE unit_compatible GROUP BY ALL)
SELECT count(*) AS sensors, count(*) FILTER (overall_status <> 'Insufficient Data') AS online,
       count(*) FILTER (r > 1 AND r <= 2) AS elevated, count(*) FILTER (r > 2) AS high
FROM overall LEFT JOIN worst USING (sensor_id)"""))
def _(spark, sf):
    latest = G.latest_status(windows(observations(spark, sf)), HOURLY)
    return G.network_status(G.overall_status(latest, HOURLY), latest)


def target_table(obs):
    """Features, 24 h averages and targets of every reading."""
    flags = obs.withColumn("missing_flag", F.col("no2").isNull())
    rows = G.window_averages(features(flags), HOURLY, GUIDES[:1])
    return G.forecast_targets(rows, HOURLY, HORIZONS)


def _horizon_sql(h: int) -> str:
    lead = (
        "max({c}) OVER (PARTITION BY sensor_id, segment ORDER BY ts RANGE BETWEEN "
        f"INTERVAL {h} HOUR FOLLOWING AND INTERVAL {h} HOUR FOLLOWING)"
    )
    return (
        f"{lead.format(c='pm25')} AS target_pm25_{h}h, {lead.format(c='pm25_avg')} AS target_pm25_who_24h_avg_{h}h, "
        f"{lead.format(c='pm25_coverage')} AS cov_{h}h, "
        f"EXISTS (SELECT 1 FROM bounds b WHERE b.sensor_id = avgs.sensor_id AND avgs.ts <= b.ts "
        f"AND avgs.ts + INTERVAL {h} HOUR > b.ts) AS future_gap_{h}h"
    )


TARGETS = FEATS + f""",
avgs AS (SELECT *, avg(pm25) OVER d AS pm25_avg, least(count(pm25) OVER d / 24 * 100, 100) AS pm25_coverage
         FROM feats WINDOW d AS {frame(24)}),
bounds AS (SELECT sensor_id, ts FROM (SELECT sensor_id, ts, lead(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS nts FROM obs)
           WHERE nts > ts + INTERVAL 90 MINUTE),
t0 AS (SELECT *, {', '.join(_horizon_sql(h) for h in (1, 3, 6))},
       pm25_lag_6h IS NOT NULL AND pm25_mean_3h IS NOT NULL AS history_available,
       pm25 IS NULL OR no2 IS NULL AS quality_issue FROM avgs),
targets AS (SELECT *, """ + ", ".join(f"""
  CASE WHEN target_pm25_who_24h_avg_{h}h IS NOT NULL AND cov_{h}h >= 75 THEN (target_pm25_who_24h_avg_{h}h > 15)::BIGINT END AS pollution_event_{h}h,
  CASE WHEN NOT history_available THEN 'INSUFFICIENT_HISTORY' WHEN future_gap_{h}h THEN 'FUTURE_MAJOR_GAP'
       WHEN target_pm25_{h}h IS NULL THEN 'MISSING_FUTURE_TARGET' WHEN quality_issue THEN 'QUALITY_ISSUE' ELSE 'VALID' END AS reason_{h}h,
  reason_{h}h = 'VALID' AS forecast_sample_valid_{h}h""" for h in (1, 3, 6)) + """ FROM t0),
validity AS (""" + " UNION ALL ".join(f"""
  SELECT sensor_id, city, ts, '{h}h' AS horizon, forecast_sample_valid_{h}h AS forecast_sample_valid, history_available,
         target_pm25_{h}h IS NOT NULL AS future_target_available, future_gap_{h}h AS future_major_gap, quality_issue,
         reason_{h}h AS invalid_reason, pollution_event_{h}h AS pollution_event FROM targets""" for h in (1, 3, 6)) + ")"
TARGET_COLS = [f"{n}_{h}h" for h in (1, 3, 6) for n in (
    "target_pm25", "target_pm25_who_24h_avg", "pollution_event", "forecast_sample_valid")]


@query("forecast_targets", sql(SEG + TARGETS, f"SELECT sensor_id, ts, {', '.join(TARGET_COLS)} FROM targets",
       " ".join(f"{c}:8" for c in TARGET_COLS if c.startswith("target"))))
def _(spark, sf):
    out = target_table(observations(spark, sf)).select("sensor_id", "ts", *TARGET_COLS)
    return rounded(out, **{c: 8 for c in TARGET_COLS})


@query("future_gap_flag", sql(SEG + TARGETS, "SELECT sensor_id, ts, future_gap_1h, future_gap_3h, future_gap_6h FROM targets"))
def _(spark, sf):
    cols = [f"future_gap_{h}h" for h in (1, 3, 6)]
    return target_table(observations(spark, sf)).select("sensor_id", "ts", *cols)


def validity(obs):
    return G.sample_validity(target_table(obs), HOURLY, HORIZONS)


@query("sample_validity", sql(SEG + TARGETS, "SELECT * FROM validity"))
def _(spark, sf):
    return validity(observations(spark, sf))


@query("sample_validity_summary", sql(SEG + TARGETS, """
SELECT horizon, sensor_id, count(*) AS total_timestamps, count(*) FILTER (forecast_sample_valid) AS valid_samples,
       count(*) FILTER (invalid_reason = 'INSUFFICIENT_HISTORY') AS invalid_history,
       count(*) FILTER (invalid_reason = 'FUTURE_MAJOR_GAP') AS invalid_future_gap,
       count(*) FILTER (invalid_reason = 'MISSING_FUTURE_TARGET') AS invalid_missing_target,
       count(*) FILTER (invalid_reason = 'QUALITY_ISSUE') AS invalid_quality,
       count(pollution_event) AS event_labels, count(*) FILTER (pollution_event = 1) AS positive_events
FROM validity GROUP BY GROUPING SETS ((horizon, sensor_id), (horizon))"""))
def _(spark, sf):
    return G.sample_validity_summary(validity(observations(spark, sf)), HOURLY)


TARGET_VALID = {f"target_pm25_{h}h": f"forecast_sample_valid_{h}h" for h in (1, 3, 6)}


def _pair_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{t}' AS target, round({f}::DOUBLE, 9) AS x, round({t}, 9) AS y FROM targets WHERE {v} AND {f} IS NOT NULL"
        for f in NUMERIC for t, v in TARGET_VALID.items()
    )


@query("feature_ranking", sql(SEG + TARGETS, f""",
p0 AS ({_pair_rows()}),
p AS (SELECT * FROM p0 SEMI JOIN (SELECT feature, target FROM p0 GROUP BY ALL HAVING count(DISTINCT x) >= 3) USING (feature, target)),
rk AS (SELECT *, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2 AS rx,
              rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2 AS ry FROM p),
b AS (SELECT feature, target, least(7, floor((rx - 0.5) * 8 / count(*) OVER g)) AS bx, least(7, floor((ry - 0.5) * 8 / count(*) OVER g)) AS by_
      FROM rk WINDOW g AS (PARTITION BY feature, target)),
c AS (SELECT *, count(*) AS c FROM b GROUP BY ALL),
t AS (SELECT feature, target, c, sum(c) OVER (PARTITION BY feature, target) AS n, sum(c) OVER (PARTITION BY feature, target, bx) AS cx,
             sum(c) OVER (PARTITION BY feature, target, by_) AS cy FROM c)
SELECT feature, target, 'absolute_pearson' AS method, abs(corr(x, y)) AS score, corr(x, y) AS signed_score, count(*) AS n
FROM p GROUP BY ALL HAVING count(*) >= 80
UNION ALL
SELECT feature, target, 'mutual_information', sum(c / n * ln(c * n / (cx * cy))), NULL, max(n)::BIGINT FROM t GROUP BY ALL HAVING max(n) >= 80""",
    "score signed_score"))
def _(spark, sf):
    table = stage(target_table(observations(spark, sf)))
    return rounded(E.feature_ranking(E.feature_target_pairs(table, NUMERIC, TARGET_VALID)))


REDUNDANT = [n for n in NUMERIC if n != "minute"]


@query("feature_redundancy", sql(SEG + FEATS, """,
pr AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS c FROM feats"
    for i, a in enumerate(REDUNDANT) for b in REDUNDANT[i + 1:]) + """)
SELECT feature_a, feature_b, c AS correlation, abs(c) AS absolute_correlation FROM pr WHERE abs(c) >= 0.95""",
    "correlation absolute_correlation"))
def _(spark, sf):
    return rounded(E.feature_redundancy(features(observations(spark, sf)), REDUNDANT))


@query("recent_quality_counts", sql(FLAGGED + ",\n" + SEG.split("obs AS (")[1].split("FROM readings GROUP BY ALL),")[1].strip(), f""",
j AS (SELECT seg.*, sampling_gap_flag, jump_flag::INT AS anomaly_count FROM seg JOIN flags USING (sensor_id, ts))
SELECT sensor_id, ts, sum(sampling_gap_flag::INT) OVER w::BIGINT AS recent_gap_count_3h,
       sum((pm25 IS NULL)::INT) OVER w::BIGINT AS recent_missing_pm25_count_3h, sum(anomaly_count) OVER w::BIGINT AS recent_anomaly_count_3h
FROM j WINDOW w AS {frame(3)}"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    rows = cleaned(obs).withColumn("anomaly_count", F.col("jump_flag").cast("int"))
    out = E.recent_quality_counts(segmented(rows), HOURLY)
    return out.select("sensor_id", "ts", "recent_gap_count_3h", "recent_missing_pm25_count_3h",
                      "recent_anomaly_count_3h")


@query("feature_target_join", sql(SEG + TARGETS, """
SELECT sensor_id, city, ts, segment, pm25_lag_1h, pm25_mean_3h, target_pm25_1h FROM targets""",
    "pm25_lag_1h pm25_mean_3h target_pm25_1h"))
def _(spark, sf):
    from sensorloom.operators.ml import one_to_one_join

    obs = hourly(spark, sf)
    keys = ["sensor_id", "city", "ts", "segment"]
    left = features(obs).select(*keys, "pm25_lag_1h", "pm25_mean_3h")
    right = target_table(obs).select(*keys, "target_pm25_1h")
    return rounded(one_to_one_join(left, right, keys))


@query("column_gate", sql(SEG + FEATS, "SELECT " + ", ".join(f"count({n}) AS {n}" for n in NUMERIC) + " FROM feats"))
def _(spark, sf):
    rows = features(observations(spark, sf))
    E.column_gate(rows.columns, NUMERIC, ["target_", "pollution_event_", "forecast_sample_valid_"])
    return rows.agg(*[F.count(n).alias(n) for n in NUMERIC])
