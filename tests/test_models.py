import itertools

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from sensorloom.functions import forecasts as P
from sensorloom.operators import ensemble, metrics, ml, serving
from sensorloom.operators.series import Series


def test_simplex_weights_beat_a_fine_grid():
    rng = np.random.default_rng(0)
    for _ in range(5):
        x = rng.normal(size=(60, 3))
        y = x @ np.array([0.9, 0.4, -0.2]) + rng.normal(size=60) * 0.1
        gram, cross = x.T @ x, x.T @ y
        w = ensemble.minimise_on_simplex(gram, cross)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-12
        value = w @ gram @ w - 2 * cross @ w
        grid = [(i / 40, j / 40) for i, j in itertools.product(range(41), repeat=2) if i + j <= 40]
        best = min(
            np.array(g) @ gram @ np.array(g) - 2 * cross @ np.array(g)
            for a, b in grid for g in [(a, b, 1 - a - b)]
        )
        assert value <= best + 1e-9


def test_non_negative_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=50)
    w = ensemble.non_negative_least_squares(x.T @ x, x.T @ y)
    slope = x.T @ x @ w - x.T @ y
    assert (w >= 0).all() and (slope >= -1e-8).all() and np.allclose(slope * w, 0, atol=1e-7)


def test_dynamic_weighting_renormalises(spark):
    rows = [("1h", 1.0, 10.0, 20.0), ("1h", 1.0, None, 20.0), ("1h", 1.0, None, None)]
    wide = spark.createDataFrame(
        rows, "horizon string, actual double, prediction_a double, prediction_b double"
    ).withColumn("prediction_c", F.lit(99.0))
    weights = spark.createDataFrame(
        [("1h", "a", 0.25), ("1h", "b", 0.75), ("1h", "c", 0.0)], "horizon string, model string, weight double"
    )
    got = ensemble.dynamic_weighting(wide, weights, ["a", "b", "c"]).collect()
    by = {(r.prediction_a, r.prediction_b): r for r in got}
    assert by[(10.0, 20.0)].predicted == 17.5 and not by[(10.0, 20.0)].fallback_used
    assert by[(None, 20.0)].predicted == 20.0 and by[(None, 20.0)].models_missing == "a"
    assert by[(None, None)].predicted is None and by[(None, None)].fallback_used


def test_index_of_pollution(spark):
    values = [-3.0, 0.0, 9.05, 9.1, 35.49, 55.45, 125.4, 225.5, 325.4, 400.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r.a) for r in df.select(P.epa_aqi(F.col("v")).alias("a")).collect()]
    assert [g[0] for g in got] == [0, 0, 50, 51, 100, 150, 200, 301, 500, 500, None]
    assert got[2][1] == "Good" and got[3][1] == "Moderate" and got[9][1] == "Hazardous"


def test_short_test_periods_have_no_metrics(spark):
    rows = [("1h", "m", s, float(i), float(i) + 1, 20.0, 10.0) for s, n in ((1, 25), (2, 5)) for i in range(n)]
    df = spark.createDataFrame(
        rows, "horizon string, model string, sensor_id int, actual double, predicted double, "
        "actual_health_average double, predicted_health_average double",
    )
    got = {r.sensor_id: r for r in metrics.sensor_metrics(df, ["horizon", "model"]).collect()}
    assert got[1].status == "OK" and got[1].mae == 1.0 and got[1].event_recall == 0.0
    assert got[2].status == "INSUFFICIENT_TEST_DATA" and got[2].mae is None and got[2].n == 5


def test_seasonal_regression_is_least_squares(spark):
    rng = np.random.default_rng(2)
    minutes = np.arange(0, 1440 * 6, 60)
    days = minutes / 1440
    y = 3 + 0.4 * days + 2 * np.sin(2 * np.pi * days) + rng.normal(size=len(days))
    df = spark.createDataFrame(
        [(1, at(int(m)), float(v)) for m, v in zip(minutes, y)], "sensor_id int, ts timestamp_ntz, v double"
    )
    got = ml.seasonal_regression(df, df, Series(), "v", order=2).orderBy("ts").collect()
    x = np.column_stack(
        [np.ones(len(days)), days]
        + [f(2 * np.pi * k * days) for k in (1, 2) for f in (np.sin, np.cos)]
    )
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([r.predicted for r in got], want, atol=1e-5)


def test_penalties_match_the_optimality_conditions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = x @ np.array([1.0, -0.5]) + 2 + rng.normal(size=80) * 0.1
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame(
        [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, _label double"
    )
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = ml.ridge(10.0, 80, y.std()).fit(rows)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)
    b = ml.elastic_net(0.2, 0.5, y.std()).fit(rows).coefficients.toArray()
    slope = xc.T @ (xc @ b - yc) / 80 + 0.1 * b
    assert np.allclose(slope, -0.1 * np.sign(b), atol=1e-5)


def test_one_to_one_join_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 3.0), (1, 4.0)], "k int, y double")
    assert ml.one_to_one_join(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="not unique"):
        ml.one_to_one_join(a, b, ["k"]).collect()


def test_top_per_group_with_one_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = serving.top_per_group(df, ["k"], 5, F.col("v").desc()).collect()
    assert sorted((r.k, r.v) for r in got) == [("cold", i) for i in range(3)] + [
        ("hot", i) for i in range(495, 500)
    ]


def test_isolation_forest_flags_the_far_point(spark):
    from sensorloom.operators.anomalies import isolation_forest

    rng = np.random.default_rng(4)
    rows = [(1, at(15 * i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows[150] = (1, at(15 * 150), 40.0, -40.0)
    df = spark.createDataFrame(rows, "sensor_id int, ts timestamp_ntz, a double, b double")
    got = isolation_forest(df, Series(), ["a", "b"], trees=40, rows_per_task=64).collect()
    assert len(got) == 300
    assert max(got, key=lambda r: r.isolation_score).ts == at(15 * 150)
    assert 1 <= sum(r.isolation_forest_flag for r in got) <= 6


def test_isolation_forest_sees_every_provided_channel(spark):
    from sensorloom.operators.anomalies import isolation_forest

    rng = np.random.default_rng(6)
    rows = [
        (k, at(15 * i), float(a), float(b), float(c) if k == 1 else None)
        for k in (1, 2) for i, (a, b, c) in enumerate(rng.normal(size=(150, 3)))
    ]
    rows[70] = (1, at(15 * 70), 0.0, 0.0, 90.0)
    rows[200] = (2, at(15 * 50), 0.0, 90.0, None)
    rows[10] = (1, at(15 * 10), 0.0, 0.0, None)
    df = spark.createDataFrame(rows, "sensor_id int, ts timestamp_ntz, a double, b double, c double")
    got = isolation_forest(df, Series(), ["a", "b", "c"], trees=40).collect()
    assert len(got) == 299
    for sensor, where in ((1, 70), (2, 50)):
        assert max((r for r in got if r.sensor_id == sensor), key=lambda r: r.isolation_score).ts == at(15 * where)


def test_components_of_embeddings_use_every_dimension(spark, tmp_path):
    from sensorloom.plans import registry

    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 20)) + 100
    x[:, 19] = x[:, 0] * 2 + rng.normal(size=200) * 0.1
    spark.createDataFrame(
        [(i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "label int, embedding array<double>"
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["pca_embeddings"](spark, str(tmp_path)).collect()
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    by = {(r.component, r.channel): r for r in got}
    assert len(by) == len(got) == 400 and {r.n for r in got} == {200}
    for c in range(20):
        v = vectors[:, 19 - c]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        assert np.allclose([by[c + 1, f"e{i}"].loading for i in range(20)], v, atol=1e-6)
        assert np.isclose(by[c + 1, "e0"].explained_ratio, values[19 - c] / values.sum())


def test_fold_metrics_do_not_depend_on_the_order_of_rows(spark):
    """Ten errors of 0.1 add up to 1; added one by one in doubles they give 0.9999999999999999."""
    from sensorloom.operators.metrics import bias_metrics, fold_summary

    rows = [("1h", "persistence", fold, 0.0, 0.1) for fold in (1, 2) for _ in range(10)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "horizon string, model string, fold int, actual double, predicted double")
        df = df.repartition(parts)
        for row in bias_metrics(df, ["horizon", "model", "fold"]).collect():
            assert (row.mae, row.bias) == (0.1, 0.1)
        assert fold_summary(df, ["horizon"]).first().mean_mae == 0.1


def test_trees_lead_every_point_to_its_leaf():
    """Leaves lead to themselves, so a tree is followed in as many steps as it may have levels."""
    import math

    import numpy as np

    from sensorloom.operators.anomalies import _average_path, _grow_tree, _path_lengths

    points = np.random.default_rng(3).integers(0, 9, (64, 3)).astype(float)
    points[:8] = points[0]
    limit = math.ceil(math.log2(64))
    table = np.array(_grow_tree(points, np.random.default_rng(42), limit), float)
    leaves: dict[int, list[int]] = {}
    depths = {}
    for i, p in enumerate(points):
        at = depth = 0
        while table[at, 2] != at:
            at, depth = int(table[at, 2 if p[int(table[at, 0])] < table[at, 1] else 3]), depth + 1
        leaves.setdefault(at, []).append(i)
        depths[at] = depth
    assert max(depths.values()) <= limit and len(leaves) == (table[:, 2] == np.arange(len(table))).sum()
    got = _path_lengths(table, points, limit)
    for at, members in leaves.items():
        assert (got[members] == depths[at] + _average_path(len(members))).all()
