"""Materialised intermediate tables.

Several operators read a derived table more than once (centre, then deviations,
then events).  ``stage`` writes such a table once, as Parquet in the shared
folder named by ``spark.checkpoint.dir``, so that later passes prune columns, a
lost executor costs a re-read instead of a recomputation, and nothing depends on
executor memory or local disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def staging_folder(spark: SparkSession) -> str:
    """The session's shared folder.

    Where none is set, a local session gets a temporary folder and a cluster a folder inside the
    warehouse, which driver and executors share.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="run-")
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
