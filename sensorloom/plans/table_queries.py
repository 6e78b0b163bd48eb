"""Queries over ingest, sinks, fingerprints and machine learning on tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from sensorloom.functions.text import repair_text
from sensorloom.operators import ml
from sensorloom.operators import relations as R
from sensorloom.operators import series as S
from sensorloom.plans.feature_queries import (
    HORIZONS, NUMERIC, SEG, TARGETS, features, segmented, target_table,
)
from sensorloom.plans.model_queries import MODELS, archive
from sensorloom.plans.network import (
    CHANNELS, CORE, HOURLY, LONG, OBS, READINGS, hourly, observations, query_table, readings,
    rounded, sql, table,
)
from sensorloom.sources import tables as X
from sensorloom.sources.staging import stage, staging_folder

QUERIES, SQL, query = query_table()

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
KINDS = {"event_id": "bigint", "user_id": "bigint", "value": "double", "props": "double",
         "event_type": "bigint", "ts": "timestamp_ntz"}


def fresh(spark) -> str:
    return f"{staging_folder(spark)}/artifact-{uuid.uuid4().hex}"


def event_text(spark, sf):
    path = fresh(spark)
    X.write_artifact(table(spark, sf, "events").select(*EVENT_COLUMNS), path, "csv")
    return X.read_text_table(spark, path, EVENT_COLUMNS)


@query("parse_problems", """
SELECT unnest(['event_id', 'user_id', 'value', 'props', 'event_type', 'ts']) AS column,
       unnest([0, 0, 0, count(props), count(event_type), 0]) AS problems FROM events""")
def _(spark, sf):
    return X.parse_problems(event_text(spark, sf), KINDS)


@query("ingest_observations", """
SELECT event_id, date_trunc('second', ts) AS ts, user_id, value, NULL::BIGINT AS event_type, NULL::DOUBLE AS props FROM events""")
def _(spark, sf):
    return X.ingest_observations(event_text(spark, sf), KINDS)


@query("keep_last", sql(READINGS, """
SELECT sensor_id, date_trunc('hour', ts) AS ts, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(k, event_id) AS k
FROM readings GROUP BY ALL"""))
def _(spark, sf):
    """Stations that stamp readings by the hour: the last arrival of each stamp."""
    rows = readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return X.keep_last(rows.select("sensor_id", "ts", "event_id", "value", "k"), ["sensor_id", "ts"], ["event_id"])


@query("lag_after_keep_last", sql(READINGS, """,
last AS (SELECT sensor_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value FROM readings GROUP BY ALL)
SELECT a.sensor_id, a.ts, a.value, b.value AS lag_1h FROM last a
LEFT JOIN last b ON a.sensor_id = b.sensor_id AND b.ts = a.ts - INTERVAL 1 HOUR"""))
def _(spark, sf):
    """Exact lags need one reading per stamp; a corrected reading counts as corrected."""
    rows = readings(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    last = X.keep_last(rows.select("sensor_id", "ts", "event_id", "value"), ["sensor_id", "ts"], ["event_id"])
    lagged = S.exact_shifts(last.withColumn("_seg", F.lit(0)), HOURLY, {"lag_1h": ("value", -60)}, "_seg")
    return lagged.select("sensor_id", "ts", "value", "lag_1h")


@query("load_clean", sql(OBS, "SELECT sensor_id, ts, pm25, no2 FROM obs", "pm25 no2"))
def _(spark, sf):
    obs, path = observations(spark, sf).select("sensor_id", "ts", "pm25", "no2"), fresh(spark)
    X.write_artifact(obs, path, "csv")
    return rounded(X.load_clean(spark, path, obs.schema, "csv"))


@query("write_artifacts", sql(OBS, """
SELECT city, sensor_id, count(*) AS rows, sum(pm25) AS pm25 FROM obs GROUP BY ALL""", "pm25"))
def _(spark, sf):
    path = fresh(spark)
    X.write_artifact(observations(spark, sf), path, "parquet", partition_by=["city"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy("city", "sensor_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("pm25").alias("pm25")
    ))


@query("write_json_summary", sql(OBS, """
SELECT '{"sensor_id":"' || sensor_id || '","readings":' || count(*) || ',"share":' || CASE WHEN count(o3) = 0 THEN 'null' ELSE '1.0' END || '}' AS json
FROM obs GROUP BY sensor_id"""))
def _(spark, sf):
    rows = observations(spark, sf).groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("readings"),
        # NaN where the channel is absent, which JSON cannot hold.
        F.when(F.count("o3") == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("share"),
    )
    return X.json_summary(rows)


@query("row_fingerprint", "SELECT count(*) AS rows, true AS unchanged FROM events")
def _(spark, sf):
    events = table(spark, sf, "events")
    return X.unchanged(events, stage(events.repartition(7, "user_id")))


@query("load_guidelines", sql(LONG, """,
g(pollutant, guideline, period, steps) AS (VALUES ('pm25', 15.0, '24h', 4), ('no2', 25.0, '24h', 2), ('o3', 100.0, '8h', 2))
SELECT pollutant, guideline::DOUBLE AS guideline, period AS averaging_period, steps AS interim_steps, avg(value) / any_value(guideline) AS mean_ratio, count(value) AS readings
FROM long JOIN g ON channel = pollutant GROUP BY ALL""", "mean_ratio"))
def _(spark, sf):
    from sensorloom.operators.guidelines import WHO_2021

    path = fresh(spark)
    document = {
        "source_version": "WHO 2021",
        "source_url": "https://www.who.int/publications/i/item/9789240034228",
        "minimum_window_coverage_percent": 75,
        "pollutants": [
            {"pollutant": g.pollutant, "guideline": g.guideline, "unit": "ug/m3",
             "averaging_period": f"{g.hours}h", "dataset_presence": "AVAILABLE",
             "unit_compatible": True, "interim_targets": g.targets}
            for g in WHO_2021
        ],
    }
    spark.range(1).select(F.lit(json.dumps(document, indent=1)).alias("value")).write.text(path)
    rules = X.load_guidelines(spark, path).select(
        "pollutant", "guideline", "averaging_period", F.size("interim_targets").alias("interim_steps")
    )
    long = S.to_long(observations(spark, sf), ["sensor_id"], CHANNELS)
    joined = long.join(rules, long.channel == rules.pollutant)
    return rounded(joined.groupBy("pollutant", "guideline", "averaging_period", "interim_steps").agg(
        F.try_divide(F.avg("value"), F.max("guideline")).alias("mean_ratio"),
        F.count("value").alias("readings"),
    ))


@query("read_predictions", sql(SEG + TARGETS, """,
p AS (SELECT 'persistence' AS model, 1 AS o, target_pm25_1h AS actual, pm25 AS predicted FROM targets UNION ALL
      SELECT 'mean3', 2, target_pm25_1h, pm25_mean_3h FROM targets)
SELECT model, count(*) AS rows, count(interval) AS intervals FROM (SELECT *, CASE WHEN model = 'mean3' THEN 1 END AS interval FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL) GROUP BY ALL"""))
def _(spark, sf):
    rows = archive(spark, sf).where("horizon = '1h'")
    base = fresh(spark)
    one = rows.where("model = 'persistence'").drop("model")
    X.write_artifact(one, f"{base}/persistence")
    two = rows.where("model = 'mean3'").drop("model").withColumn("interval", F.lit(1))
    X.write_artifact(two, f"{base}/mean3")
    long = X.read_predictions(spark, base, ["persistence", "mean3"])
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count("interval").alias("intervals")
    )


@query("repair_text", """
SELECT doc_id, length(replace(replace(replace(text, chr(226) || chr(8364) || chr(8221), '-'), chr(226) || chr(8224) || chr(8221), '<->'), chr(226) || chr(8224) || chr(8217), '->')) AS repaired_length,
       lower(lang) = lower(upper(lang)) AS same_language FROM documents""")
def _(spark, sf):
    from sensorloom.functions.text import same_text

    return table(spark, sf, "documents").select(
        "doc_id", F.length(repair_text(F.col("text"))).cast("long").alias("repaired_length"),
        same_text(F.col("lang"), F.upper("lang")).alias("same_language"),
    )


ENDS = ("2024-01-15", "2024-01-22", "2024-01-28")


@query("chronological_split", sql(OBS, """
SELECT split, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM (
  SELECT ts, CASE WHEN ts < '2024-01-15' THEN 'train' WHEN ts < '2024-01-22' THEN 'validation' WHEN ts < '2024-01-28' THEN 'test' END AS split FROM obs)
WHERE split IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    rows = observations(spark, sf).withColumn("split", ml.chronological_split("ts", *ENDS))
    return rows.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


FOLDS = [("2024-01-15", "2024-01-20"), ("2024-01-20", "2024-01-25")]


@query("expanding_folds", sql(OBS, """,
f(fold, a, b) AS (VALUES (1, TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-20'), (2, TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-25'))
SELECT fold, CASE WHEN ts < a THEN 'train' ELSE 'validation' END AS role, count(*) AS rows FROM obs CROSS JOIN f WHERE ts < b GROUP BY ALL"""))
def _(spark, sf):
    return ml.expanding_folds(observations(spark, sf), "ts", FOLDS).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("median_impute", sql(OBS, """,
m AS (SELECT quantile_cont(no2, 0.5) AS a, quantile_cont(o3, 0.5) AS b FROM obs WHERE ts < '2024-01-15')
SELECT sensor_id, ts, coalesce(no2, a) AS no2, coalesce(o3, b) AS o3, (no2 IS NULL)::INT AS no2_missing, (o3 IS NULL)::INT AS o3_missing FROM obs CROSS JOIN m""", "no2 o3"))
def _(spark, sf):
    obs = hourly(spark, sf).select("sensor_id", "ts", "no2", "o3")
    train = obs.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return rounded(ml.median_impute(train, obs, ["no2", "o3"], indicators=True))


@query("standard_scale", sql(OBS, """,
m AS (SELECT avg(pm25) AS a, stddev_pop(pm25) AS s, avg(temperature) AS ta, stddev_pop(temperature) AS ts_ FROM obs WHERE ts < '2024-01-15')
SELECT sensor_id, ts, (pm25 - a) / s AS pm25, (temperature - ta) / ts_ AS temperature FROM obs CROSS JOIN m""", "pm25 temperature"))
def _(spark, sf):
    obs = hourly(spark, sf).select("sensor_id", "ts", "pm25", "temperature")
    train = obs.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return rounded(ml.standard_scale(train, obs, ["pm25", "temperature"]))


CHANGE = """,
l AS (SELECT a.sensor_id, a.ts, m AS lag_minutes, a.pm25 AS x, b.pm25 AS y, a.pm25 - b.pm25 AS change FROM seg a CROSS JOIN (SELECT unnest([60, 180, 360])::INT AS m)
      JOIN seg b ON b.sensor_id = a.sensor_id AND b.segment = a.segment AND b.ts = a.ts - to_minutes(m))"""


@query("change_profile", sql(SEG + CHANGE, """
SELECT sensor_id, lag_minutes, count(*) AS n, corr(x, y) AS autocorrelation, avg(abs(change)) AS mean_absolute_change,
       quantile_cont(abs(change), 0.5) AS median_absolute_change FROM l GROUP BY ALL""",
    "autocorrelation mean_absolute_change median_absolute_change"))
def _(spark, sf):
    return rounded(R.change_profile(segmented(hourly(spark, sf)), HOURLY, "pm25", HORIZONS)[0])


@query("largest_changes", sql(SEG + CHANGE, """,
r AS (SELECT sensor_id, lag_minutes, 'negative' AS direction, row_number() OVER (PARTITION BY sensor_id, lag_minutes ORDER BY change, ts)::INT AS rank, ts, change FROM l
      UNION ALL SELECT sensor_id, lag_minutes, 'positive', row_number() OVER (PARTITION BY sensor_id, lag_minutes ORDER BY change DESC, ts)::INT, ts, change FROM l)
SELECT * FROM r WHERE rank <= 5""", "change"))
def _(spark, sf):
    return rounded(R.change_profile(segmented(hourly(spark, sf)), HOURLY, "pm25", HORIZONS)[1])


@query("pca", sql(OBS, """,
r AS (SELECT city, count(*) AS n, corr(pm25, aqi) AS r FROM obs GROUP BY city)
SELECT city, n, component, (1 + CASE WHEN component = 1 THEN abs(r) ELSE -abs(r) END) / 2 AS explained_ratio,
       CASE WHEN component = 1 THEN (1 + abs(r)) / 2 ELSE 1.0 END AS cumulative_ratio, channel, sqrt(0.5) AS absolute_loading
FROM r CROSS JOIN (SELECT unnest([1, 2])::INT AS component) CROSS JOIN (SELECT unnest(['pm25', 'aqi']) AS channel)""",
    "explained_ratio cumulative_ratio absolute_loading"))
def _(spark, sf):
    out = ml.pca(hourly(spark, sf), ["pm25", "aqi"], "city")
    return rounded(out.withColumn("absolute_loading", F.abs("loading")).drop("loading"))


@query("pca_channels")
def _(spark, sf):
    return rounded(ml.pca_by_presence(hourly(spark, sf), CHANNELS, "city"))


@query("pca_summary")
def _(spark, sf):
    return ml.pca_summary(stage(ml.pca_by_presence(hourly(spark, sf), CHANNELS, "city")), "city")


@query("pca_embeddings")
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0])]
    wide = rows.select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return ml.pca(wide, names)


@query("kmeans_select")
def _(spark, sf):
    rows = stage(table(spark, sf, "embeddings"))
    evaluated, _ = ml.kmeans_select(ml.as_vector(rows, "embedding"), "features", range(2, 7))
    return evaluated


@query("cluster_assignments")
def _(spark, sf):
    rows = stage(table(spark, sf, "embeddings"))
    vectors = ml.as_vector(rows, "embedding")
    _, model = ml.kmeans_select(vectors, "features", range(2, 7))
    return model.transform(vectors).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("cluster_profiles", """
WITH e AS (SELECT label AS cluster, 'e' || (i - 1) AS channel, embedding[i]::DOUBLE AS value
      FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
o AS (SELECT channel, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY ALL),
p AS (SELECT cluster, channel, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
             (avg(value) - any_value(m)) / any_value(s) AS standardized, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM embeddings) AS share
      FROM e JOIN o USING (channel) GROUP BY ALL)
SELECT cluster, channel, count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(standardized, 6) AS standardized,
       round(share, 6) AS share, row_number() OVER (PARTITION BY cluster ORDER BY abs(standardized) DESC, channel) <= 2 AS distinguishing FROM p""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0])]
    wide = rows.select(
        F.col("label").alias("cluster"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    return rounded(ml.cluster_profiles(wide, names))


FEATURES = ["pm25", "temperature", "humidity", "pm25_lag_1h", "pm25_lag_3h", "pm25_mean_3h", "sin_hour", "cos_hour"]
TARGET = "target_pm25_1h"


def training(spark, sf):
    rows = target_table(observations(spark, sf)).where("forecast_sample_valid_1h")
    return stage(rows.select("sensor_id", "ts", *dict.fromkeys([*FEATURES, TARGET, "pm25"])))


def _split(rows):
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def _scored(spark, sf, model):
    rows = training(spark, sf)
    train, test = _split(rows)
    scored, _ = ml.fit_predict(train, test, model, FEATURES, TARGET)
    error = F.col(TARGET) - F.col("predicted")
    return scored.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


@query("forest_forecast")
def _(spark, sf):
    return _scored(spark, sf, ml.ForecastModel("forest", ml.forest(trees=20, depth=6)))


@query("boosted_forecast")
def _(spark, sf):
    return _scored(spark, sf, ml.ForecastModel("boosted", ml.boosted(rounds=10, depth=3, step=0.1)))


@query("delta_formulation")
def _(spark, sf):
    return _scored(spark, sf, ml.ForecastModel("delta", ml.boosted(rounds=10, depth=3, step=0.1), delta=True))


@query("feature_importance")
def _(spark, sf):
    train, test = _split(training(spark, sf))
    model = ml.ForecastModel("forest", ml.forest(trees=20, depth=6))
    _, fitted = ml.fit_predict(train, test, model, FEATURES, TARGET)
    return ml.feature_importance(fitted, FEATURES, spark)


@query("oof_predictions")
def _(spark, sf):
    model = ml.ForecastModel("forest", ml.forest(trees=10, depth=5))
    return ml.oof_predictions(
        training(spark, sf), "ts", FOLDS, model, FEATURES, TARGET, ["sensor_id", "ts"]
    )


@query("seasonal_regression")
def _(spark, sf):
    obs = hourly(spark, sf)
    train, test = _split(obs)
    scored = ml.seasonal_regression(train, test, HOURLY, "pm25")
    return scored.select("sensor_id", "ts", "pm25", "predicted")
