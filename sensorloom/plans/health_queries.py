"""Queries over sensor health and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import alerts as A
from sensorloom.operators import health as H
from sensorloom.plans.audit_queries import FLAGGED, IDS, PLONG, cleaned
from sensorloom.plans.model_queries import FORECASTS, SEG, report
from sensorloom.plans.network import (
    CHANNELS, HOURLY, OBS, hourly, query_table, rounded, sql,
)
from sensorloom.operators.audit import provided_long
from sensorloom.sources.staging import stage

QUERIES, SQL, query = query_table()

# Thresholds for hourly readings; runs between gaps are short, so are the least references.
RULES = H.HealthRules(
    minor_gap=90.0, major_gap=180.0, offline=240.0, flat_samples=2,
    flat_minutes=60.0, jump_references=6, noise_window=4, noise_references=6, noise_scale=1.5,
    noise_signs=2, drift_recent=6, drift_baseline=8, drift_scale=1.0, cross_recent=2,
    cross_references=12, cross_scale=2.0,
)

GAPS = """,
link AS (SELECT sensor_id, ts, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS pts FROM obs),
stamps AS (SELECT sensor_id, t AS ts, date_diff('minute', pts, t)::DOUBLE AS delay
           FROM (SELECT sensor_id, pts, ts, unnest(generate_series(pts + INTERVAL 1 HOUR, ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t
                 FROM link WHERE ts > pts + INTERVAL 1 HOUR)),
gap_issues AS (
  SELECT sensor_id, ts, CASE WHEN g >= 180 THEN 'major_sampling_gap' ELSE 'sampling_gap' END AS type,
         CASE WHEN g >= 180 THEN 'critical' ELSE 'warning' END AS severity, NULL::VARCHAR AS channel,
         g AS gap_minutes, greatest(1, round_even(g / 60, 0)::BIGINT - 1)::DOUBLE AS missed_intervals
  FROM (SELECT *, date_diff('minute', pts, ts)::DOUBLE AS g FROM link) WHERE g > 90
  UNION ALL
  SELECT sensor_id, ts, CASE WHEN delay >= 240 THEN 'offline' WHEN delay >= 180 THEN 'major_sampling_gap' ELSE 'missing_timestamp' END,
         CASE WHEN delay >= 180 THEN 'critical' ELSE 'warning' END, NULL, delay, greatest(1, floor(delay / 60))
  FROM stamps WHERE delay > 90)"""
VALUES = """,
value_issues AS (
  SELECT sensor_id, ts, CASE WHEN value IS NULL THEN 'missing_reading' ELSE 'suspicious_value' END AS type,
         CASE WHEN value IS NULL THEN 'warning' ELSE 'critical' END AS severity, channel
  FROM plong WHERE value IS NULL OR value < CASE channel WHEN 'temperature' THEN -50 ELSE 0 END
     OR value > CASE channel WHEN 'temperature' THEN 70 WHEN 'humidity' THEN 100 END)"""


def quant(values: str, p: float) -> str:
    return f"list_aggregate({values}, 'quantile_cont', {p})"


def mad(values: str, center: str) -> str:
    return f"1.4826 * list_aggregate([abs(x - {center}) for x in {values}], 'quantile_cont', 0.5)"


DETECT = """,
runs AS (SELECT sensor_id, ts, sum(CASE WHEN pts IS NULL OR ts > pts + INTERVAL 90 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY sensor_id ORDER BY ts) AS run FROM link),
hist AS (SELECT sensor_id, channel, ts, coalesce(list(value) FILTER (value IS NOT NULL) OVER w, []) AS v,
                coalesce(list(ts) FILTER (value IS NOT NULL) OVER w, []) AS t
         FROM plong JOIN runs USING (sensor_id, ts)
         WINDOW w AS (PARTITION BY sensor_id, channel, run ORDER BY ts ROWS UNBOUNDED PRECEDING)),
h1 AS (SELECT *, len(v) AS n, [v[i + 1] - v[i] for i in range(1, len(v))] AS d FROM hist),
h2 AS (SELECT *, [abs(x) for x in d[:-2]] AS ref, d[-4:] AS dn, d[:-5] AS dr, v[:-7] AS base, v[-6:] AS rec,
              greatest(0.0025, 0.001 * (""" + quant("v[:-2]", 0.75) + " - " + quant("v[:-2]", 0.25) + """)) AS tol FROM h1),
h3 AS (SELECT *, coalesce(list_max([i for i in range(1, n + 1) if abs(v[i] - v[n]) > tol]), 0) AS stop,
              """ + quant("ref", 0.5) + " AS rmed, " + quant("base", 0.5) + " AS bmed, " + quant("rec", 0.5) + " AS recmed, " \
    + quant("dn", 0.5) + " AS nmed, " + quant("dr", 0.5) + """ AS drmed FROM h2),
h4 AS (SELECT *, n - stop AS fcount, date_diff('minute', t[stop + 1], t[n])::DOUBLE AS fdur,
    greatest(rmed + 8 * """ + mad("ref", "rmed") + ", " + quant("ref", 0.75) + " + 3 * (" + quant("ref", 0.75) + " - " + quant("ref", 0.25) + """), 0.01) AS jl,
    """ + mad("dn", "nmed") + " AS nmad, greatest(" + mad("dr", "drmed") + ", 0.01) AS drmad, greatest(" + mad("base", "bmed") + """, 0.01) AS bscale,
    len([i for i in range(1, len(dn)) if dn[i] * dn[i + 1] < 0]) AS signs, recmed - bmed AS shift FROM h3),
detector_issues AS (
  SELECT sensor_id, ts, channel, 'flatline' AS type, fdur AS measure, fcount::DOUBLE AS reference FROM h4 WHERE n >= 2 AND fcount >= 2 AND fdur >= 60
  UNION ALL SELECT sensor_id, ts, channel, 'jump', abs(d[-1]), jl FROM h4 WHERE n - 1 >= 7 AND abs(d[-1]) >= jl
  UNION ALL SELECT sensor_id, ts, channel, 'abnormal_noise', nmad, drmad FROM h4 WHERE n - 1 >= 10 AND nmad > 1.5 * drmad AND signs >= 2
  UNION ALL SELECT sensor_id, ts, channel, 'possible_drift', shift, bscale FROM h4 WHERE n >= 14 AND abs(shift) > 1.0 * bscale
    AND len([x for x in rec if (x - bmed) * sign(shift) > 0]) / 6 >= 0.8)"""
CROSS = """,
big AS (SELECT city FROM obs GROUP BY city HAVING count(DISTINCT sensor_id) >= 3),
resid AS (SELECT a.sensor_id, a.ts, any_value(a.pm25) - quantile_cont(b.pm25, 0.5) AS r FROM obs a JOIN big USING (city)
          JOIN obs b ON b.city = a.city AND b.ts = a.ts AND b.sensor_id <> a.sensor_id GROUP BY a.sensor_id, a.ts),
x1 AS (SELECT sensor_id, ts, lag(ts) OVER o AS pts, list(r) OVER w AS v FROM resid
       WINDOW o AS (PARTITION BY sensor_id ORDER BY ts), w AS (PARTITION BY sensor_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
x2 AS (SELECT *, v[:-3] AS ref, v[-2:] AS rec, """ + quant("v[:-3]", 0.5) + """ AS c FROM x1 WHERE len(v) >= 14 AND ts <= pts + INTERVAL 1 HOUR),
x3 AS (SELECT *, greatest(""" + mad("ref", "c") + """, 0.01) AS scale, sign(""" + quant("rec", 0.5) + """ - c) AS dir FROM x2),
cross_issues AS (SELECT sensor_id, ts, 'pm25' AS channel, c AS reference_center, scale AS robust_scale FROM x3
                 WHERE dir <> 0 AND len([x for x in rec if (x - c) * dir > 2 * scale]) = 2)"""
ISSUES = GAPS + VALUES + DETECT + CROSS + """,
issues AS (SELECT sensor_id, ts, type, severity, channel FROM gap_issues UNION ALL SELECT sensor_id, ts, type, severity, channel FROM value_issues
  UNION ALL SELECT sensor_id, ts, type, 'warning', channel FROM detector_issues
  UNION ALL SELECT sensor_id, ts, 'cross_sensor_inconsistency', 'warning', channel FROM cross_issues)"""


def values(obs):
    return provided_long(obs, HOURLY, CHANNELS, IDS)


def issues(obs):
    return H.health_issues(obs, HOURLY, CHANNELS, RULES)


@query("health_gaps", sql(OBS + GAPS, "SELECT * EXCLUDE (channel) FROM gap_issues"))
def _(spark, sf):
    rows = H.health_gaps(hourly(spark, sf), HOURLY, RULES)
    return rows.select(
        "sensor_id", "ts", "type", "severity",
        F.col("evidence")["gap_minutes"].alias("gap_minutes"),
        F.col("evidence")["missed_intervals"].alias("missed_intervals"),
    )


@query("health_absence", sql(OBS + GAPS, "SELECT sensor_id, ts, delay AS minutes_since_last_reading FROM stamps"))
def _(spark, sf):
    return H.missing_stamps(hourly(spark, sf), HOURLY)


@query("health_missing_suspicious", sql(PLONG + VALUES, "SELECT * FROM value_issues"))
def _(spark, sf):
    return H.health_values(values(hourly(spark, sf)), HOURLY).drop("evidence")


MEASURES = {
    "flatline": ("duration_minutes", "samples"),
    "jump": ("absolute_change", "threshold"),
    "abnormal_noise": ("recent_difference_mad", "reference_difference_mad"),
    "possible_drift": ("median_shift", "robust_scale"),
}


def _detector(name: str, kind: str) -> None:
    @query(name, sql(PLONG + GAPS + DETECT, f"SELECT * FROM detector_issues WHERE type = '{kind}'", "measure:9 reference:9"))
    def _(spark, sf):
        statistics = H.run_statistics(hourly(spark, sf), HOURLY, RULES, CHANNELS)
        rows = H.detector_issues(statistics, HOURLY, RULES).where(F.col("type") == kind)
        measure, reference = MEASURES[kind]
        return rounded(rows.select(
            "sensor_id", "ts", "channel", "type",
            F.col("evidence")[measure].alias("measure"),
            F.col("evidence")[reference].alias("reference"),
        ), measure=9, reference=9)


_detector("health_flatline", "flatline")
_detector("health_jump", "jump")
_detector("health_noise", "abnormal_noise")
_detector("health_drift", "possible_drift")


@query("health_cross_sensor", sql(OBS + CROSS, "SELECT * FROM cross_issues", "reference_center robust_scale"))
def _(spark, sf):
    rows = H.cross_sensor_issues(hourly(spark, sf), HOURLY, RULES)
    return rounded(rows.select(
        "sensor_id", "ts", "channel",
        F.col("evidence")["reference_center"].alias("reference_center"),
        F.col("evidence")["robust_scale"].alias("robust_scale"),
    ))


POINTS = "CASE type " + " ".join(f"WHEN '{k}' THEN {p}" for k, (_, p) in H.ISSUE_PENALTIES.items()) + " ELSE 0 END"
WHERE_DIM = {d: ", ".join(f"'{k}'" for k, (w, _) in H.ISSUE_PENALTIES.items() if w == d) for d in H.DIMENSION_WEIGHTS}
SCORE = ISSUES + """,
base AS (SELECT sensor_id, ts, 0.0::DOUBLE AS m, 1 AS row_present FROM obs UNION ALL SELECT sensor_id, ts, delay, 0 FROM stamps),
dims AS (SELECT sensor_id, ts, """ + ", ".join(
    f"greatest(0, 100 - coalesce(sum({POINTS}) FILTER (type IN ({kinds})), 0))::INT AS {d}" for d, kinds in WHERE_DIM.items()) + """,
    """ + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in H.ISSUE_PENALTIES) + """,
    count(type) AS issue_count, count(*) FILTER (severity = 'critical') AS critical_issue_count,
    any_value(m) AS minutes_since_last_reading, any_value(row_present)::INT AS source_row_present
  FROM base LEFT JOIN issues USING (sensor_id, ts) GROUP BY sensor_id, ts),
pts AS (SELECT *, round_even(""" + " + ".join(f"{d} * {w}::DOUBLE" for d, w in H.DIMENSION_WEIGHTS.items()) + """, 0)::INT AS points FROM dims),
health AS (SELECT *, CASE WHEN n_offline > 0 THEN 'Offline' WHEN critical_issue_count > 0 THEN 'Critical' WHEN points >= 90 AND issue_count = 0 THEN 'Healthy'
    WHEN points >= 65 THEN 'Warning' ELSE 'Critical' END AS status, CASE WHEN n_offline > 0 THEN 0 ELSE points END AS health_score FROM pts),
history AS (SELECT sensor_id, ts, status, health_score, n_missing_reading + n_missing_timestamp AS missing_count,
    (n_sampling_gap + n_major_sampling_gap + n_offline > 0)::INT AS gap_flag, (n_flatline > 0)::INT AS flatline_flag, (n_jump > 0)::INT AS jump_flag,
    (n_abnormal_noise > 0)::INT AS noise_flag, (n_possible_drift > 0)::INT AS possible_drift_flag, (n_suspicious_value > 0)::INT AS suspicious_value_flag,
    (n_cross_sensor_inconsistency > 0)::INT AS cross_sensor_inconsistency_flag, issue_count, critical_issue_count, minutes_since_last_reading, source_row_present
  FROM health)"""


def scored(obs):
    return H.health_score(obs, HOURLY, stage(issues(obs)))


@query("health_score", sql(PLONG + SCORE, """
SELECT sensor_id, ts, availability, integrity, stability, consistency, drift, status, health_score FROM health"""))
def _(spark, sf):
    return scored(hourly(spark, sf)).select(
        "sensor_id", "ts", *H.DIMENSION_WEIGHTS, "status", "health_score"
    )


@query("health_history", sql(PLONG + SCORE, "SELECT * FROM history"))
def _(spark, sf):
    return H.health_history(scored(hourly(spark, sf)), HOURLY)


@query("health_summary", sql(PLONG + SCORE, """
SELECT sensor_id, count(*) AS evaluated, """ + ", ".join(
    f"round(100.0::DOUBLE * count(*) FILTER (status = '{s}') / count(*), 3) AS {s.lower()}_percent" for s in H.STATUSES) + """,
  min(health_score) AS lowest_score, arg_max(status, ts) AS current_status, arg_max(health_score, ts) AS current_score, max(ts) AS current_timestamp
FROM history GROUP BY sensor_id"""))
def _(spark, sf):
    return H.health_summary(H.health_history(scored(hourly(spark, sf)), HOURLY), HOURLY)


@query("issue_json", sql(PLONG + ISSUES, """
SELECT sensor_id, type, severity, channel, count(*) AS issues FROM issues GROUP BY ALL"""))
def _(spark, sf):
    listed = H.issue_list(issues(hourly(spark, sf)), HOURLY)
    return H.issue_rows(listed, HOURLY).groupBy("sensor_id", "type", "severity", "channel").agg(
        F.count(F.lit(1)).alias("issues")
    )


@query("merge_event_blocks", sql(PLONG + ISSUES, """,
i0 AS (SELECT sensor_id, ts, type, severity, coalesce(channel, '') AS channel FROM issues),
i1 AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS o FROM i0
       WINDOW w AS (PARTITION BY sensor_id, type, channel, severity ORDER BY ts)),
i2 AS (SELECT *, sum(o) OVER (PARTITION BY sensor_id, type, channel, severity ORDER BY ts) AS b FROM i1)
SELECT sensor_id, type, channel, severity, min(ts) AS start_timestamp, max(ts) AS end_timestamp,
       date_diff('minute', min(ts), max(ts))::DOUBLE AS duration_minutes, count(*) AS evaluations
FROM i2 GROUP BY sensor_id, type, channel, severity, b"""))
def _(spark, sf):
    blocks = H.merge_event_blocks(stage(issues(hourly(spark, sf))), HOURLY, 90.0)
    return blocks.drop("first_evidence", "last_evidence")


FLAG_PAIRS = {
    "jump_flag": "jump_flag", "flatline_flag": "flatline_flag",
    "possible_drift_flag": "possible_drift_flag", "sampling_gap_flag": "gap_flag",
    "suspicious_value_flag": "suspicious_value_flag",
}
AGREEMENT = f"""
WITH c AS (WITH {FLAGGED} SELECT * FROM cleaned), h AS (WITH {PLONG + SCORE} SELECT * FROM history),
p AS (SELECT unnest([{', '.join(f"'{a}'" for a in FLAG_PAIRS)}]) AS flag,
             unnest([{', '.join(f'c.{a}' for a in FLAG_PAIRS)}]) AS old,
             unnest([{', '.join(f'h.{b} = 1' for b in FLAG_PAIRS.values())}]) AS new
      FROM c JOIN h ON c.sensor_id = h.sensor_id AND c.ts = h.ts WHERE h.source_row_present = 1)
SELECT flag, count(*) AS rows_compared, count(*) FILTER (old) AS existing_positive,
       count(*) FILTER (new) AS engine_positive, count(*) FILTER (old AND new) AS both_positive,
       round(100.0::DOUBLE * count(*) FILTER (old = new) / count(*), 3) AS agreement_percent,
       CASE WHEN count(*) FILTER (old) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (old AND new) / count(*) FILTER (old), 3) END AS existing_detected_percent,
       CASE WHEN count(*) FILTER (new) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (old AND new) / count(*) FILTER (new), 3) END AS engine_matching_percent
FROM p GROUP BY flag"""


@query("flag_agreement", AGREEMENT)
def _(spark, sf):
    obs = hourly(spark, sf)
    history = H.health_history(scored(obs), HOURLY).where("source_row_present = 1")
    old = cleaned(obs)
    pairs = FLAG_PAIRS
    before = old.select("sensor_id", "ts", *[F.col(c).alias(f"_o_{c}") for c in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("flag"), F.col(f"_o_{a}").alias("old"), (F.col(b) == 1).alias("new"))
        for a, b in pairs.items()
    ])
    rows = before.join(history, ["sensor_id", "ts"]).select(F.explode(cells).alias("_c")).select("_c.*")
    return H.flag_agreement(rows)


COOLDOWN = 180
POLICY = """CASE WHEN risk_level = 'High' AND horizon = '1h' THEN 2 WHEN risk_level IN ('High', 'Elevated') THEN 1 END"""
PRIORITY = """CASE WHEN risk_level = 'High' THEN CASE horizon WHEN '1h' THEN 3 ELSE 2 END WHEN risk_level = 'Elevated' THEN CASE horizon WHEN '1h' THEN 2 ELSE 1 END END"""
CONDITIONS = FORECASTS + ISSUES + f""",
cond AS (
  SELECT sensor_id || ':high_pm_risk:' || horizon || ':pm25' AS dedup_key, sensor_id, ts, horizon AS source, 'high_pm_risk' AS type,
         {POLICY} AS sev, {PRIORITY} AS pri, horizon, 'pm25' AS channel, risk_level AS condition_level FROM report WHERE risk_level <> 'Normal'
  UNION ALL SELECT sensor_id || ':who_exceedance:' || horizon || ':pm25', sensor_id, ts, horizon, 'who_exceedance', 1, 1, horizon, 'pm25', who_status
  FROM report WHERE who_status = 'Above WHO Guideline'
  UNION ALL SELECT sensor_id || ':sensor_offline', sensor_id, ts, 'health', 'sensor_offline', 2, 3, NULL, NULL, 'Offline' FROM issues WHERE type = 'offline'
  UNION ALL SELECT sensor_id || ':possible_drift:' || channel, sensor_id, ts, 'health', 'possible_drift', 1, 2, NULL, channel, 'possible_drift' FROM issues WHERE type = 'possible_drift'
  UNION ALL SELECT sensor_id || ':suspicious_reading:' || channel, sensor_id, ts, 'health', 'suspicious_reading', 2, 3, NULL, channel, severity FROM issues WHERE type = 'suspicious_value'),
supplied AS (SELECT DISTINCT sensor_id, ts, horizon AS source FROM report UNION SELECT sensor_id, ts, 'health' FROM (SELECT sensor_id, ts FROM obs UNION ALL SELECT sensor_id, ts FROM stamps)),
evals AS (SELECT k.dedup_key, s.ts, c.sev, c.pri, c.sev IS NOT NULL AS present,
                 row_number() OVER (PARTITION BY k.dedup_key ORDER BY s.ts) AS rn
          FROM (SELECT DISTINCT dedup_key, sensor_id, source FROM cond) k JOIN supplied s USING (sensor_id, source)
          LEFT JOIN cond c ON c.dedup_key = k.dedup_key AND c.ts = s.ts)"""
SEG_PLONG = SEG + "," + PLONG.split("FROM readings GROUP BY ALL),", 1)[1]
LIFECYCLE = CONDITIONS + f""",
fold AS (
  SELECT dedup_key, ts, rn, present, sev, pri, CASE WHEN present THEN 'new' END AS transition, present AS notify,
         CASE WHEN present THEN ts END AS last_notified, CASE WHEN present THEN ts END AS created_at FROM evals WHERE rn = 1
  UNION ALL
  SELECT e.dedup_key, e.ts, e.rn, e.present, e.sev, e.pri,
    CASE WHEN e.present AND NOT f.present THEN 'new' WHEN NOT e.present AND f.present THEN 'resolved'
         WHEN e.present AND (e.sev > f.sev OR e.pri > f.pri) THEN 'escalated' WHEN e.present THEN 'updated' END,
    e.present AND (NOT f.present OR e.sev > f.sev OR e.pri > f.pri OR e.ts >= f.last_notified + INTERVAL {COOLDOWN} MINUTE),
    CASE WHEN e.present AND (NOT f.present OR e.sev > f.sev OR e.pri > f.pri OR e.ts >= f.last_notified + INTERVAL {COOLDOWN} MINUTE) THEN e.ts ELSE f.last_notified END,
    CASE WHEN e.present AND NOT f.present THEN e.ts ELSE f.created_at END
  FROM fold f JOIN evals e ON e.dedup_key = f.dedup_key AND e.rn = f.rn + 1),
life AS (SELECT dedup_key, ts, 'alert_' || substr(sha256(dedup_key || '|' || strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16) AS id,
    created_at, transition, notify AS notification_recommended, sev, pri FROM fold WHERE transition IS NOT NULL)"""


def supplied_health(obs):
    """The stamps health is judged at: those of readings and those where one is missing."""
    return obs.select("sensor_id", "ts").unionByName(
        H.missing_stamps(obs, HOURLY).select("sensor_id", "ts")
    )


def alert_inputs(spark, sf):
    obs = hourly(spark, sf)
    forecasts = stage(report(spark, sf))
    return forecasts, stage(issues(obs)), supplied_health(obs)


@query("alert_conditions", sql(SEG_PLONG + CONDITIONS, """
SELECT dedup_key, sensor_id, ts, source, type, ['info', 'warning', 'critical'][sev + 1] AS severity,
       ['low', 'medium', 'high', 'urgent'][pri + 1] AS priority, horizon, channel, condition_level FROM cond"""))
def _(spark, sf):
    forecasts, found, _ = alert_inputs(spark, sf)
    return A.alert_conditions(forecasts, found).select(
        "dedup_key", "sensor_id", "ts", "source", "type", "severity", "priority", "horizon",
        "channel", "condition_level",
    )


@query("forecast_health_merge", sql(SEG_PLONG + CONDITIONS, """
SELECT coalesce(f.sensor_id, h.sensor_id) AS sensor_id, coalesce(f.ts, h.ts) AS ts, f.horizons, h.ts IS NOT NULL AS has_health
FROM (SELECT sensor_id, ts, array_to_string(list(horizon ORDER BY horizon), ',') AS horizons FROM report GROUP BY ALL) f
FULL JOIN (SELECT sensor_id, ts FROM obs UNION SELECT sensor_id, ts FROM stamps) h ON f.sensor_id = h.sensor_id AND f.ts = h.ts"""))
def _(spark, sf):
    # Which issues were found does not matter here, only when health was judged.
    forecasts, health = report(spark, sf), supplied_health(hourly(spark, sf))
    return A.forecast_health_merge(forecasts, health).withColumn(
        "horizons", F.array_join("horizons", ",")
    )


def lifecycle(spark, sf):
    forecasts, found, health = alert_inputs(spark, sf)
    conditions = stage(A.alert_conditions(forecasts, found))
    return A.alert_lifecycle(conditions, A.evaluations(forecasts, health), COOLDOWN)


@query("alert_lifecycle", "WITH RECURSIVE " + SEG_PLONG + LIFECYCLE + """
SELECT dedup_key, ts, id, created_at, transition, notification_recommended, ['info', 'warning', 'critical'][sev + 1] AS severity FROM life""")
def _(spark, sf):
    return lifecycle(spark, sf).select(
        "dedup_key", "ts", "id", "created_at", "transition", "notification_recommended", "severity"
    )


@query("alert_summary", "WITH RECURSIVE " + SEG_PLONG + LIFECYCLE + """,
al AS (SELECT id, dedup_key, created_at, split_part(dedup_key, ':', 1) AS sensor_id, split_part(dedup_key, ':', 2) AS type,
   CASE WHEN arg_max(transition, ts) <> 'resolved' THEN 'active' ELSE 'resolved' END AS status,
   ['info', 'warning', 'critical'][arg_max(sev, ts) FILTER (transition <> 'resolved') + 1] AS severity,
   count(*) FILTER (transition = 'escalated') AS escalations,
   count(*) FILTER (transition IN ('updated', 'escalated') AND NOT notification_recommended) AS suppressed FROM life GROUP BY ALL)
SELECT dimension, value, count(*) AS alerts, sum(suppressed)::BIGINT AS suppressed, sum(escalations)::BIGINT AS escalations
FROM (SELECT *, unnest(['severity', 'type', 'sensor_id', 'status']) AS dimension, unnest([severity, type, sensor_id, status]) AS value FROM al) GROUP BY ALL""")
def _(spark, sf):
    return A.alert_summary(A.alert_table(lifecycle(spark, sf)))


@query("health_arrival_gap", sql(OBS + GAPS, """
SELECT sensor_id, ts, type, severity, gap_minutes, missed_intervals FROM gap_issues JOIN obs USING (sensor_id, ts)"""))
def _(spark, sf):
    obs = hourly(spark, sf)
    rows = H.health_gaps(obs, HOURLY, RULES).join(obs.select("sensor_id", "ts"), ["sensor_id", "ts"], "left_semi")
    return rows.select(
        "sensor_id", "ts", "type", "severity",
        F.col("evidence")["gap_minutes"].alias("gap_minutes"),
        F.col("evidence")["missed_intervals"].alias("missed_intervals"),
    )
