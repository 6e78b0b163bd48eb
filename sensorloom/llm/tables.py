"""Reading the input tables, and column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources.staging import stage

__all__ = ["KEY", "ascii_lower", "bounded_broadcast", "stage", "table", "training_rows", "with_key"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    # For ASCII texts lower() gives the same and is much faster.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


KEY = ["_doc", "_text_hash"]


def with_key(docs: DataFrame) -> DataFrame:
    """Adds ``KEY``, two non-null numbers that stand for a row's id and text.

    Rows that agree in both are copies of one another and are treated alike.
    """
    return docs.withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"),
            "_text_hash": F.xxhash64(F.col("text"), F.col("doc_id").isNull()),
        }
    )


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint if the counted rows stay within the limit, else none."""
    return F.broadcast(df) if rows <= limit else df


def training_rows(labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """A bounded, seeded choice of labelled documents outside the held-out fold.

    Returns ``_id``, ``_y`` and ``_weight``, the number of labelled rows that each chosen row
    stands for.  About ``per_class`` ids of each label value are chosen by hash, all if there are
    fewer.  Null ids and labels take no part; an id with several labels counts once, with the
    largest.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("doc_id"))
        .agg(F.max(label).alias("_y"))
        .where(fold != held)
        .select(F.col("doc_id").alias("_id"), "_y")
    )
    share = ids.groupBy("_y").agg(F.least(F.lit(1.0), F.lit(float(per_class)) / F.count("*")).alias("_share"))
    draw = (F.xxhash64(F.lit("training"), "_id").bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    return ids.join(share, "_y").where(draw < F.col("_share")).select(
        "_id", "_y", (1 / F.col("_share")).alias("_weight")
    )
