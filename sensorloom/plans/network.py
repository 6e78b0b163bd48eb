"""Views of the driver tables as a sensor network, for Spark and for SQL.

Each event type of each group of ``GROUP_USERS`` users is a sensor, so the number
of sensors grows with the data while each series stays dense; the first group's
sensors have the plain type as name.  ``observations`` is the hourly table the
analytics run on.  ``user_readings`` reads each user as a sparse sensor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.series import Series
from sensorloom.sources.staging import stage

EAST = ("click", "signup", "view")
CHANNELS = ["pm25", "temperature", "humidity", "no2", "o3", "aqi"]
CORE = ["pm25", "temperature", "humidity"]
GROUP_USERS = 500

HOURLY = Series(cadence_minutes=60, gap_minutes=90)
RAW = Series(ties=("event_id",), cadence_minutes=15, gap_minutes=90)
USERS = Series(ties=("event_id",), cadence_minutes=60, gap_minutes=24 * 60)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col: str | Column) -> Column:
    return F.round(col, 6)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Doubles to six places (or as named), for comparison."""
    return df.select(
        *[
            F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    group = F.floor(F.col("user_id") / GROUP_USERS)
    sensor = F.when(group == 0, F.col("event_type")).otherwise(
        F.concat_ws("-", "event_type", group.cast("string"))
    )
    return table(spark, sf, "events").select(
        sensor.alias("sensor_id"),
        "event_type",
        F.when(F.col("event_type").isin(*EAST), "east").otherwise("west").alias("city"),
        "ts",
        "event_id",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def observations(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The hourly table; with bounds, only of the raw readings that its hours in them need."""
    # Means go through an exact decimal sum, so that every engine and every
    # partitioning gives the same double and ties below are decided alike.
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")

    def mean(col: Column) -> Column:
        return F.sum(col.cast("decimal(18,2)")).cast("double") / F.count(col)

    raw = readings(spark, sf)
    if start is not None:
        raw = raw.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        raw = raw.where(F.col("ts") < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR"))
    return (
        raw.groupBy("sensor_id", "city", hour)
        .agg(
            mean(F.col("value")).alias("pm25"),
            mean(F.col("k")).alias("temperature"),
            F.max("k").alias("humidity"),
            mean(F.when(F.col("k") >= 50, F.col("value"))).alias("no2"),
            F.min(F.when(F.col("city") == "west", F.col("value"))).alias("o3"),
            F.max("value").alias("aqi"),
        )
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Observations written once, for queries that read them in several passes."""
    return stage(observations(spark, sf))


def user_readings(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select(
        F.col("user_id").alias("sensor_id"), "ts", "event_id", F.col("event_type").alias("kind"),
        "value", "k",
    )


READINGS = f"""readings AS (
  SELECT CASE WHEN user_id // {GROUP_USERS} = 0 THEN event_type
              ELSE event_type || '-' || (user_id // {GROUP_USERS}) END AS sensor_id, event_type,
         CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'east' ELSE 'west' END AS city,
         ts, event_id, user_id, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

OBS = READINGS + """,
obs AS (
  SELECT sensor_id, city, date_trunc('hour', ts) AS ts,
         sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS pm25, sum(k) / count(*) AS temperature,
         max(k) AS humidity,
         sum(value::DECIMAL(18,2)) FILTER (k >= 50)::DOUBLE / nullif(count(*) FILTER (k >= 50), 0) AS no2,
         min(value) FILTER (city = 'west') AS o3, max(value) AS aqi
  FROM readings GROUP BY ALL)"""

LONG = OBS + """,
long AS (
  SELECT sensor_id, city, ts, channel, value FROM (
    SELECT sensor_id, city, ts,
           unnest(['pm25', 'temperature', 'humidity', 'no2', 'o3', 'aqi']) AS channel,
           unnest([pm25, temperature, humidity, no2, o3, aqi]) AS value
    FROM obs)),
provided AS (
  SELECT sensor_id, channel FROM long GROUP BY ALL HAVING count(value) > 0)"""

SEG = OBS + """,
prior AS (SELECT *, lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS pts FROM obs),
seg AS (
  SELECT * EXCLUDE (pts), date_diff('second', pts, ts) / 60.0::DOUBLE AS minutes_since_previous,
         CAST(sum(CASE WHEN pts IS NULL OR ts > pts + INTERVAL 90 MINUTE OR ts <= pts
                       THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY ts) AS BIGINT) AS segment
  FROM prior)"""


def sql(prelude: str, body: str, doubles: str = "") -> str:
    """Prelude plus body; ``doubles`` names result columns to round to six places.

    ``name:8`` rounds to eight instead.  The body may start with a comma to add further common tables.
    """
    text = f"WITH {prelude}\n{body}"
    if not doubles:
        return text
    named = [c.partition(":") for c in doubles.split()]
    places = ", ".join(f"round({c}, {n or 6}) AS {c}" for c, _, n in named)
    return f"SELECT * REPLACE ({places}) FROM (\n{text}\n)"


def query_table():
    """Two registries (queries and their SQL) and the decorator that fills them."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(fn):
            if name in queries:
                raise ValueError(f"query registered twice: {name}")
            queries[name] = fn
            if oracle is not None:
                texts[name] = oracle
            return fn

        return add

    return queries, texts, query
