"""Text ingest, typed re-reads, configuration, sinks and archives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.rows import single_row

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with every column as text, so that source fields survive unchanged."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def typed(column: str, kind: str) -> Column:
    """Coercing parse; NaN becomes null."""
    parsed = F.expr(f"try_cast(`{column}` AS {kind})")
    return F.nanvl(parsed, F.lit(None).cast("double")) if kind == "double" else parsed


def ingest_observations(text: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Typed columns; ``kinds`` maps column to type, other columns stay text."""
    return text.select(
        *[typed(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in text.columns]
    )


def keep_last(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Of the rows that agree in ``keys`` the one that arrived last.

    A feed repeats and corrects readings; the row with the greatest ``arrival`` (an id, an offset or
    an ingest time, then what breaks its ties) replaces the others.  One aggregate with map-side
    combination, so a reading that was sent a million times is one row per map task.  Null arrivals
    come before all others; null keys are a group of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    # A struct as order: its nulls are least, where max_by skips rows whose order is null.
    order = F.struct(*[F.col(c) for c in arrival])
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def parse_problems(text: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Per column: values that are present but do not parse; one pass."""
    failed = [
        F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {k})").isNull()).alias(c)
        for c, k in kinds.items()
    ]
    return text.agg(*failed).unpivot([], list(kinds), "column", "problems")


def load_clean(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A cleaned table with its declared schema (no inference pass)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("timestampNTZFormat", ISO).csv(path)
    return reader.format(fmt).load(path)


GUIDELINE_SCHEMA = (
    "source_version string, source_url string, minimum_window_coverage_percent int, "
    "pollutants array<struct<pollutant:string,guideline:double,unit:string,"
    "averaging_period:string,dataset_presence:string,dataset_unit:string,"
    "unit_compatible:boolean,interim_targets:map<string,double>>>"
)


def load_guidelines(spark: SparkSession, path: str) -> DataFrame:
    """One row per pollutant of a nested JSON file, with the file-level fields."""
    raw = spark.read.schema(GUIDELINE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(
        "source_version", "source_url", "minimum_window_coverage_percent",
        F.explode("pollutants").alias("_p"),
    ).select(
        "source_version", "source_url", "minimum_window_coverage_percent", "_p.*"
    )


def write_artifact(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """A named table as Parquet or CSV with ISO timestamps."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("timestampFormat", ISO).option(
            "timestampNTZFormat", ISO
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as null."""
    return df.select(
        *[
            F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
            if t == "double"
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def json_summary(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as a JSON object with explicit nulls."""
    safe = json_safe(df)
    return safe.select(
        F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias(out)
    )


def row_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent signature of the whole table."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("signature"),
    )


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows, up to order."""
    was = F.col("_was")
    same = (F.col("rows") == was["rows"]) & F.col("signature").eqNullSafe(was["signature"])
    return (
        row_fingerprint(after)
        .withColumn("_was", single_row(row_fingerprint(before)))
        .select("rows", same.alias("unchanged"))
    )


def read_predictions(spark: SparkSession, base: str, models: Sequence[str]) -> DataFrame:
    """Per-model prediction folders as one long archive; missing columns become null."""
    out = None
    for model in models:
        part = spark.read.parquet(f"{base}/{model}").withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# How prediction columns and the actual column are named.
PREDICTION_PREFIXES = ["prediction_", "pred_"]
PREDICTION_SUFFIXES = ["_prediction", "_pred"]
ACTUAL_NAMES = ["actual", "y_true", "target_actual", "actual_value", "true_value"]
