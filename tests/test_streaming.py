import random

from conftest import at
from pyspark.sql import functions as F

from sensorloom.operators import features, series
from sensorloom.operators.features import FeaturePlan
from sensorloom.operators.series import Series
from sensorloom.plans.stream_queries import as_stream
from sensorloom.streaming import buffers, windows

S = Series()
PLAN = FeaturePlan(lags={"pm25": [15, 60]}, rolling={"pm25": {60: ["mean", "std"], 180: ["median", "range"]}})
NAMES = [*PLAN.lag_names(), *PLAN.rolling_names()]


def readings(spark, n=60):
    rng = random.Random(1)
    rows, minute = [], 0
    for i in range(n):
        minute += rng.choice([15, 15, 15, 30, 200])
        rows += [(s, at(minute), rng.choice([None, float(rng.randint(1, 50))])) for s in (1, 2)]
    return spark.createDataFrame(rows, "sensor_id int, ts timestamp, pm25 double")


def flat(row, names):
    """Values; sums over the same readings may differ in their last digits."""
    return tuple(round(row[n], 9) if isinstance(row[n], float) else row[n] for n in names)


def live(df, slices):
    out = windows.run_to_end(buffers.live_features(as_stream(df, slices), PLAN, S))
    return {(r.sensor_id, r.ts): flat(r, ["segment", "buffered", *NAMES]) for r in out.collect()}


def test_micro_batches_do_not_matter_and_batch_agrees(spark):
    df = readings(spark)
    one, four = live(df, 1), live(df, 4)
    assert one == four and len(one) == df.count()
    batch = features.series_features(series.segment_series(df, S), S, PLAN)
    for r in batch.collect():
        got = one[(r.sensor_id, r.ts)][2:]
        for a, b in zip(got, [r[n] for n in NAMES]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-8)


def test_a_reading_that_is_not_newer_resets_the_buffer(spark):
    times = [0, 15, 30, 15, 30]
    feed = spark.createDataFrame(
        [(1, at(m), float(i)) for i, m in enumerate(times)], "sensor_id int, ts timestamp, pm25 double"
    )
    from sensorloom.sources.staging import staging_folder
    import uuid

    windows.use_rocksdb(spark)
    path = f"{staging_folder(spark)}/late-{uuid.uuid4().hex}"
    rows = feed.collect()
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, feed.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = windows.run_to_end(buffers.live_features(stream, PLAN, S)).collect()
    assert sorted((r.segment, r.buffered, r.reset) for r in out) == [
        (1, 1, True), (1, 2, False), (1, 3, False), (2, 1, True), (2, 2, False),
    ]


def test_neither_arrival_nor_batches_matter_with_a_watermark(spark):
    """Readings that arrive shuffled, up to two hours late, in 1, 2 and 7 batches give one result."""
    from sensorloom.sources.staging import staging_folder
    import uuid

    windows.use_rocksdb(spark)
    df = readings(spark)
    rng = random.Random(4)
    rows = sorted(df.collect(), key=lambda r: (r.ts.timestamp() + rng.uniform(0, 7200), r.sensor_id))
    # A repeated stamp: the later arrival counts, also in another batch.
    twin = next(i for i, r in enumerate(rows) if r.pm25 is not None)
    rows.insert(twin, (*rows[twin][:2], -1.0))
    results = []
    for batches in (1, 2, 7):
        path = f"{staging_folder(spark)}/shuffled-{uuid.uuid4().hex}"
        size = -(-len(rows) // batches)
        for at_row in range(0, len(rows), size):
            part = spark.createDataFrame(rows[at_row : at_row + size], df.schema).coalesce(1)
            part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = windows.run_to_end(buffers.live_features(stream, PLAN, S, lateness_minutes=120))
        results.append({(r.sensor_id, r.ts): flat(r, ["segment", "buffered", "reset", *NAMES]) for r in out.collect()})
    assert results[0] == results[1] == results[2]
    last = max(r.ts for r in df.collect())
    settled = {k: v for k, v in live(df, 1).items() if (last - k[1]).total_seconds() > 7200}
    assert settled.keys() == results[0].keys() and len(settled) > 60
    for k, (segment, buffered, *values) in settled.items():
        got = results[0][k]
        assert got[:2] == (segment, buffered)
        for a, b in zip(values, got[3:]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-8)


def test_history_gate(spark):
    df = spark.createDataFrame([(1,), (25,), (121,)], "n int")
    got = df.select(*[buffers.history_gate(F.col("n"), m).alias(m) for m in ("persistence", "lightgbm", "tft")])
    assert [tuple(r) for r in got.collect()] == [
        (True, False, False), (True, True, False), (True, True, True),
    ]
