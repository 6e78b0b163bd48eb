import bisect
import random

import numpy as np
import pandas as pd
import pytest

from sensorloom.functions import quantiles
from sensorloom.functions.quantiles import exact_quantiles, robust_scale, value_ranks, with_average_rank
from sensorloom.sources.staging import stage

PROBS = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}


def samples():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=501),
        "ties": rng.integers(0, 4, 300).astype(float),
        "heavy": np.concatenate([rng.normal(size=99), [1e300, -1e300, 1e-300]]),
        "narrow": 1e6 + rng.random(200) * 1e-3,
        "signed": np.concatenate([-(10.0 ** rng.uniform(-5, 5, 80)), [0.0, -0.0, 0.0]]),
        "one": np.array([7.5]),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(v)) for k, values in samples().items() for v in values]
    rows += [("normal", float("nan")), ("normal", float("inf")), ("normal", None)]
    return spark.createDataFrame(rows, "k string, v double")


def test_quantiles_are_exact(table):
    for r in exact_quantiles(table, ["k"], "v", PROBS).collect():
        want = np.quantile(samples()[r.k], list(PROBS.values()))
        got = [r[name] for name in PROBS]
        assert np.allclose(got, want, rtol=1e-12, atol=0), r.k


def test_whole_table_without_keys(table):
    got = exact_quantiles(table, [], "v", {"m": 0.5}).first()
    assert got.m == pytest.approx(np.median(np.concatenate(list(samples().values()))))


def test_average_ranks_match_pandas(table):
    got = value_ranks(table, ["k"], "v").toPandas()
    for k, values in samples().items():
        want = dict(zip(values, pd.Series(values).rank()))
        part = got[got.k == k]
        assert len(part) == len(set(values))
        assert all(want[v] == pytest.approx(r) for v, r in zip(part.v, part.average_rank))
        assert (part.group_size == len(values)).all()


def test_robust_scale(table):
    for r in robust_scale(table, ["k"], "v", 2.0).collect():
        v = samples()[r.k]
        assert r["median"] == pytest.approx(np.median(v))
        assert r["mad"] == pytest.approx(2.0 * np.median(np.abs(v - np.median(v))))


def test_narrow_ranges_are_cut_into_parts(spark):
    """100,000 distinct air pressures lie in two bins; no part holds more than a few times PART_ROWS."""
    from pyspark.sql import functions as F

    from sensorloom.functions import quantiles as Q

    rng = np.random.default_rng(3)
    v = 1013 + 3 * rng.random(100_000)
    table = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v})).repartition(4)
    binned = Q._binned(table, ["k"], "v")
    assert binned.groupBy("_bin").count().count() <= 2
    sizes = Q.with_parts(binned, ["k"]).groupBy("_bin", "_part").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * Q.PART_ROWS
    got = exact_quantiles(table, ["k"], "v", PROBS).first()
    assert np.allclose([got[n] for n in PROBS], np.quantile(v, list(PROBS.values())), rtol=1e-12)
    ranks = value_ranks(table, ["k"], "v").toPandas().sort_values("v")
    assert (ranks.average_rank.to_numpy() == np.arange(1, 100_001)).all()


def test_bin_cuts_give_the_bins_of_average_ranks(spark):
    rng = random.Random(11)
    rows = [("one", rng.choice([0.0, 1.0, 2.5, rng.uniform(-3, 3)])) for _ in range(700)]
    rows += [("narrow", 100 + rng.randrange(90) * 1e-9) for _ in range(300)] + [("few", 1.0), ("few", 2.0)]
    rows += [("flat", 4.0)] * 20
    table = spark.createDataFrame(rows, "k string, v double")
    cuts = {r.k: r.cuts for r in quantiles.bin_cuts(table, ["k"], "v", 8, "cuts").collect()}
    assert set(cuts) == {"one", "narrow", "few", "flat"}
    for key in cuts:
        values = sorted(v for k, v in rows if k == key)
        n = len(values)
        for v in set(values):
            rank = bisect.bisect_left(values, v) + (values.count(v) + 1) / 2
            want = min(int((rank - 0.5) * 8 / n), 7)
            assert sum(c <= v for c in cuts[key]) == want


def test_rank_tables_are_not_sent_through_the_driver(spark):
    table = stage(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double"))
    plan = with_average_rank(table, ["k"], "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
