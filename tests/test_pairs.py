"""Agreement of sensor pairs in cells against joined pairs."""

import random

import pytest
from conftest import at

from sensorloom.operators import relations as R
from sensorloom.operators.pairs import MEASURES, group_agreement
from sensorloom.plans import stats_queries


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows = [
        (city, f"{city}{k}", channel, at(60 * t), rng.choice([None, 0.0, float(rng.randrange(6)), rng.uniform(-5, 5)]))
        for city in "ew" for k in range(6) for channel in ("pm25", "o3") for t in range(rng.choice([1, 3, 9, 40]))
    ]
    rows += [("e", "flat", "pm25", at(60 * t), 2.0) for t in range(30)]
    return spark.createDataFrame(rows, "city string, sensor_id string, channel string, ts timestamp_ntz, value double")


def by_pair(df):
    return {(r.sensor_a, r.sensor_b, r.channel): r for r in df.collect()}


@pytest.mark.parametrize(("block", "longest"), [(1 << 20, 1 << 20), (30, 1 << 20), (30, 20)])
def test_cells_of_blocks_equal_joined_pairs(readings, block, longest):
    pairs = R.sensor_pairs(readings, "city")
    want = by_pair(R.pair_agreement(R.pairwise_sensor_join(readings, pairs)))
    got = by_pair(group_agreement(readings, "city", block, longest))
    assert want.keys() == got.keys() and len(want) > 40
    for key, row in want.items():
        assert got[key].overlap_count == row.overlap_count
        for m in MEASURES:
            assert got[key][m] == (None if row[m] is None else pytest.approx(row[m], abs=1e-9)), (key, m)


def test_pairs_of_a_group_are_joined_without_shuffling_pairs(readings):
    joined = R.group_pair_join(readings, "city")
    want = R.pairwise_sensor_join(readings, R.sensor_pairs(readings, "city"))
    names = ["sensor_a", "sensor_b", "channel", "ts", "x", "y"]
    assert sorted(joined.select(*names).collect()) == sorted(want.select(*names).collect())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(city") == 2 == plan.count("Exchange ")


@pytest.mark.parametrize("partners", [1, 2, 5, 256])
def test_pairs_of_a_group_with_repeated_and_null_keys(spark, partners):
    rng = random.Random(5)
    rows = [
        (rng.choice(["e", "w", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice(["pm25", "o3", None]),
         rng.choice([at(0), at(60), None]), rng.choice([None, 0.0, float("nan"), 1.5]))
        for _ in range(150)
    ]
    table = spark.createDataFrame(
        rows, "city string, sensor_id string, channel string, ts timestamp_ntz, value double"
    )
    want = sorted(
        str((b[1], b[2], b[3], a[1], a[4], b[4]))
        for a in rows for b in rows
        if None not in a and None not in b and a[1] < b[1] and (a[0], *a[2:4]) == (b[0], *b[2:4])
    )
    joined = R.group_pair_join(table, "city", partners=partners)
    assert sorted(str(tuple(r)) for r in joined.collect()) == want and len(want) > 40


def test_pairs_are_written_by_all_partitions_from_arrays_of_partners(readings):
    joined = R.group_pair_join(readings, "city")
    assert joined.rdd.getNumPartitions() == int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 1
    assert "Generate inline" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_readings_are_rounded_before_they_are_paired(spark, tmp_path):
    rows = [(k, at(k % 3), k % 4, "click" if k % 2 else "view", k / 7, '{"k": %d}' % k) for k in range(40)]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).write.parquet(str(tmp_path / "events.parquet"))
    paired = stats_queries.QUERIES["pairwise_sensor_join"](spark, str(tmp_path))
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("round(")
    for r in paired.where("channel = 'pm25'").collect():
        assert (r.x, r.y) == (round(r.x, 6), round(r.y, 6))
    assert paired.count() > 0
