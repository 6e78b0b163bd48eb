"""Windowed aggregates over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources.staging import staging_folder


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state outside the JVM heap; keyed list state needs it."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def tumbling_resample(
    stream: DataFrame, minutes: int = 15, late: str = "30 minutes", value: str = "value"
) -> DataFrame:
    """Mean per sensor and bucket; a bucket is final once the watermark passes it."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("sensor_id", F.window("ts", f"{minutes} minutes"))
        .agg(F.avg(value).alias("mean"), F.count(value).alias("readings"))
        .select("sensor_id", F.col("window.start").alias("start"), "mean", "readings")
    )


def sliding_rolling(
    stream: DataFrame, hours: int = 3, slide: str = "1 hour", late: str = "30 minutes",
    value: str = "value",
) -> DataFrame:
    """Statistics of overlapping windows, as readings arrive."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("sensor_id", F.window("ts", f"{hours} hours", slide))
        .agg(
            F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
            F.count(value).alias("readings"),
        )
        .select("sensor_id", F.col("window.end").alias("end"), "mean", "min", "max", "readings")
    )


def session_segments(
    stream: DataFrame, gap_minutes: int = 90, late: str = "30 minutes"
) -> DataFrame:
    """Continuous segments as session windows: a longer gap opens a new one."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("sensor_id", F.session_window("ts", f"{gap_minutes} minutes"))
        .agg(
            F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select("sensor_id", "start_time", "end_time", "readings")
    )


def run_to_end(
    df: DataFrame, output_mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run a finite stream to its end and return what it wrote.

    The sink and the checkpoint live in the shared staging folder, so a restarted
    query continues where it stopped.
    """
    import uuid

    spark = df.sparkSession
    base = f"{staging_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = (
        df.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(output_mode)
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{base}/out")
    return finish(out) if finish else out


def as_ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
