import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2026, 1, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


@pytest.fixture()
def segment_frame(spark):
    """Ten readings every 15 minutes, and four more two days later."""

    def build(second_part: bool = True):
        minutes = [15 * i for i in range(10)]
        if second_part:
            minutes += [2 * 1440 + 15 * i for i in range(4)]
        rows = [(1, at(m), float(i + 1), 20.0, 50.0) for i, m in enumerate(minutes)]
        return spark.createDataFrame(
            rows, "sensor_id int, ts timestamp_ntz, pm25 double, temperature double, humidity double"
        )

    return build
