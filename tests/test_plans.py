"""Shapes of physical plans that must hold at scale, and queries beside their SQL."""

import pytest
from compare import compare, duck

from sensorloom.operators import series, serving
from sensorloom.plans import registry
from sensorloom.plans.network import HOURLY, table

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "segment_series_raw", "exact_lag", "backward_rolling", "resample_grid", "stride_sample",
    "gap_events", "jump_events", "missing_summary", "descriptive_stats_raw", "ecdf",
    "spearman_raw", "temporal_profile", "pair_agreement", "peer_residual", "who_windows",
    "forecast_targets", "sample_validity_summary", "regression_metrics", "high_tail_metrics",
    "fold_summary", "promotion_gate", "weighted_ensemble", "anomaly_univariate", "change_points",
    "health_history", "alert_lifecycle", "row_fingerprint", "parse_problems",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_callable_and_every_sql_a_query():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert len(queries) > 180 and set(oracle) <= set(queries)
    assert all(callable(q) for q in queries.values())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    problem = compare(
        spark, duck(SMALL), name, registry.queries()[name], registry.oracle_sql()[name], SMALL
    )
    assert problem in (None, "both empty")


def test_filters_and_columns_reach_the_scan(spark):
    events = table(spark, SMALL, "events")
    rows = serving.serve_filtered(events, start="2024-01-05").select("ts", "value")
    text = plan(rows)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_all_windows_of_a_halo_share_one_exchange(spark):
    events = table(spark, SMALL, "events").selectExpr("event_type AS sensor_id", "ts", "value", "1 AS segment")
    wanted = {f"m{h}": ("value", 60 * h, "mean") for h in (1, 3, 6, 12, 24)}
    text = plan(series.backward_rolling(events, HOURLY, wanted))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Window [") == 1
    assert "Join" not in text


def test_no_window_spans_a_whole_series(spark):
    events = table(spark, SMALL, "events").selectExpr("event_type AS sensor_id", "ts", "value")
    text = plan(series.segment_series(events, HOURLY))
    # The one window by sensor alone runs over block summaries, after an aggregate.
    assert "hashpartitioning(sensor_id#" in text and "_blk" in text


def test_rolling_summary_moves_its_windows_once(spark):
    """The quantiles read the moved windows from a staged table, they do not move them again."""
    assert "FlatMapGroupsInArrow" not in plan(registry.queries()["rolling_summary"](spark, SMALL))


def test_near_event_join_flags_its_rows_once(spark):
    assert "FlatMapGroupsInArrow" not in plan(registry.queries()["near_event_join"](spark, SMALL))
