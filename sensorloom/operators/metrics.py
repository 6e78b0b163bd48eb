"""Forecast metrics, rankings, gates and method selection.

Predictions are long: one row per key, horizon and model with ``actual`` and
``predicted`` (and the 24 h health averages where events are judged).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, finite
from sensorloom.functions.sums import steady_mean, steady_sum

EVENT_THRESHOLD = 15.0
MIN_SENSOR_ROWS = 20


def finite_pairs(df: DataFrame) -> DataFrame:
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in ("actual", "predicted")})
    return clean.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def r_squared() -> Column:
    """1 - SSE / SST with the centred total; null below two rows.

    Actual values without variation score 1 when they are met exactly, else 0.
    """
    error = F.col("actual") - F.col("predicted")
    missed = steady_sum(error * error)
    total = F.var_pop("actual") * F.count(F.lit(1))
    score = F.when(total > 0, 1 - missed / total).otherwise((missed == 0).cast("double"))
    return F.when(F.count(F.lit(1)) >= 2, score)


def _with_median(df: DataFrame, basic: DataFrame, keys: Sequence[str]) -> DataFrame:
    errors = df.withColumn("_abs", F.abs(F.col("actual") - F.col("predicted")))
    median = exact_quantiles(errors, keys, "_abs", {"median_absolute_error": 0.5})
    return basic.join(median, list(keys))


def regression_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = finite_pairs(df)
    error = F.col("actual") - F.col("predicted")
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        steady_mean(F.abs(error)).alias("mae"),
        F.sqrt(steady_mean(error * error)).alias("rmse"),
        r_squared().alias("r2"),
        (F.avg(F.when(F.abs("actual") >= 1, F.abs(error / F.col("actual")))) * 100).alias("mape"),
    )
    return _with_median(rows, basic, keys)


def bias_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = finite_pairs(df)
    error = F.col("predicted") - F.col("actual")
    n = F.count(F.lit(1))
    basic = rows.groupBy(*keys).agg(
        n.alias("n"),
        steady_mean(F.abs(error)).alias("mae"),
        F.sqrt(steady_mean(error * error)).alias("rmse"),
        r_squared().alias("r2"),
        steady_mean(error).alias("bias"),
        F.count_if(error < 0).alias("underprediction_count"),
        (F.count_if(error < 0) / n).alias("underprediction_rate"),
        F.count_if(error > 0).alias("overprediction_count"),
        (F.count_if(error > 0) / n).alias("overprediction_rate"),
    )
    return _with_median(rows, basic, keys)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def event_metrics(
    df: DataFrame,
    keys: Sequence[str],
    actual: str = "actual_health_average",
    predicted: str = "predicted_health_average",
) -> DataFrame:
    """Confusion metrics of "average above the guideline"."""
    rows = df.where(
        finite(F.col(actual)).isNotNull() & finite(F.col(predicted)).isNotNull()
    )
    a, p = F.col(actual) > EVENT_THRESHOLD, F.col(predicted) > EVENT_THRESHOLD
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_n"),
        F.count_if(a & p).alias("_tp"),
        F.count_if(~a & ~p).alias("_tn"),
        F.count_if(~a & p).alias("false_positives"),
        F.count_if(a & ~p).alias("false_negatives"),
    )
    tp, tn = F.col("_tp"), F.col("_tn")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counted.select(
        *keys,
        "event_n",
        ((tp + tn) / F.col("event_n")).alias("event_accuracy"),
        precision.alias("event_precision"),
        recall.alias("event_recall"),
        _ratio(2 * precision * recall, precision + recall).alias("event_f1"),
        _ratio(tn, tn + fp).alias("event_specificity"),
        "false_positives",
        "false_negatives",
    )


def sensor_metrics(df: DataFrame, keys: Sequence[str], minimum: int = MIN_SENSOR_ROWS) -> DataFrame:
    """Metrics per sensor; too short test periods only get their row count."""
    by = [*keys, "sensor_id"]
    both = regression_metrics(df, by).join(event_metrics(df, by), by, "left")
    enough = F.col("n") >= minimum
    values = [c for c in both.columns if c not in (*by, "n")]
    return both.select(
        *by,
        "n",
        F.when(enough, "OK").otherwise("INSUFFICIENT_TEST_DATA").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in values],
    )


def tail_thresholds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P90 and P95 of the actual values per group."""
    return exact_quantiles(df, keys, "actual", {"p90": 0.90, "p95": 0.95})


def residual_margin(df: DataFrame, keys: Sequence[str], quantile: float = 0.95) -> DataFrame:
    """Quantile of the underprediction ``max(actual - predicted, 0)`` per group."""
    rows = finite_pairs(df).withColumn(
        "_under", F.greatest(F.col("actual") - F.col("predicted"), F.lit(0.0))
    )
    return exact_quantiles(rows, keys, "_under", {"safety_margin": quantile})


def underprediction(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    error = F.col("predicted") - F.col("actual")
    under = F.when(error < 0, -error)
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.count(under).alias("underprediction_count"),
        (F.count(under) / n).alias("underprediction_rate"),
        F.coalesce(F.avg(under), F.lit(0.0)).alias("mean_underprediction"),
        F.coalesce(F.max(under), F.lit(0.0)).alias("worst_underprediction"),
    )


def _tail_rows(
    df: DataFrame, group: Sequence[str], thresholds: DataFrame | None, with_all: bool
) -> DataFrame:
    """Rows repeated for each subset (all, p90, p95) they belong to."""
    limits = thresholds if thresholds is not None else tail_thresholds(df, group)
    options = [F.struct(F.lit(p).alias("subset"), F.col(p).alias("threshold")) for p in ("p90", "p95")]
    if with_all:
        options.insert(
            0, F.struct(F.lit("all").alias("subset"), F.lit(None).cast("double").alias("threshold"))
        )
    inside = F.filter(
        F.array(*options),
        lambda o: o["threshold"].isNull() | (F.col("actual") >= o["threshold"]),
    )
    joined = df.join(limits.select(*group, "p90", "p95"), list(group))
    return joined.withColumn("_s", F.explode(inside)).select("*", "_s.subset", "_s.threshold").drop(
        "_s"
    )


def high_tail_metrics(
    df: DataFrame,
    keys: Sequence[str],
    group: Sequence[str] = ("horizon",),
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Metrics where the actual value is at or above P90 and P95 (inclusive)."""
    rows = _tail_rows(finite_pairs(df), group, thresholds, with_all=False)
    out = underprediction(rows, [*keys, "subset", "threshold"])
    return out


def underprediction_analysis(df: DataFrame, keys: Sequence[str], group=("horizon",)) -> DataFrame:
    """Subsets all, P90 and P95 by method."""
    rows = _tail_rows(finite_pairs(df), group, None, with_all=True)
    return underprediction(rows, [*keys, "subset"])


def safest_methods(table: DataFrame) -> DataFrame:
    """Method with the lowest rate, mean and worst underprediction per horizon and subset."""
    by = ["horizon", "subset"]

    def best(score: str) -> Column:
        return F.min_by("model", F.struct(F.col(score), F.col("model")))

    return table.groupBy(*by).agg(
        best("underprediction_rate").alias("safest_by_rate"),
        best("mean_underprediction").alias("safest_by_mean"),
        best("worst_underprediction").alias("safest_by_worst"),
    )


def model_pairs(wide: DataFrame, models: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Model pairs side by side from the wide archive: no self join.

    ``wide`` has ``prediction_<model>`` and ``residual_<model>``.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"),
                F.lit(b).alias("model_b"),
                F.col(f"prediction_{a}").alias("pa"),
                F.col(f"prediction_{b}").alias("pb"),
                F.col(f"residual_{a}").alias("ra"),
                F.col(f"residual_{b}").alias("rb"),
            )
            for i, a in enumerate(models)
            for b in models[i + 1:]
        ]
    )
    both = F.filter(cells, lambda c: c["pa"].isNotNull() & c["pb"].isNotNull())
    return wide.select(*ids, F.explode(both).alias("_c")).select(*ids, "_c.*")


def model_diversity(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Prediction and residual correlation, and how often both errors are large."""
    keys = ["horizon", "model_a", "model_b"]
    pairs = model_pairs(wide, models, ["horizon"]).withColumns(
        {"_ea": F.abs("ra"), "_eb": F.abs("rb")}
    )
    basic = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap"),
        F.corr("pa", "pb").alias("prediction_correlation"),
        F.corr("ra", "rb").alias("residual_correlation"),
    )
    limits = exact_quantiles(pairs, keys, "_ea", {"_qa": 0.75}).join(
        exact_quantiles(pairs, keys, "_eb", {"_qb": 0.75}), keys
    )
    large = pairs.join(limits, keys).groupBy(*keys).agg(
        F.count_if((F.col("_ea") >= F.col("_qa")) & (F.col("_eb") >= F.col("_qb"))).alias(
            "both_large_error_count"
        )
    )
    return basic.join(large, keys)


# Leaderboard metrics and their direction.
LOWER_IS_BETTER = {"rmse": True, "mae": True, "r2": False, "event_recall": False, "event_f1": False}


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Rank of every model per horizon and metric; models without the metric are left out."""
    long = metrics.unpivot(
        ["horizon", "model"], list(LOWER_IS_BETTER), "metric", "value"
    ).where(F.col("value").isNotNull())
    lower = F.col("metric").isin(*[m for m, low in LOWER_IS_BETTER.items() if low])
    order = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    rank = F.row_number().over(Window.partitionBy("horizon", "metric").orderBy(order, "model"))
    return long.withColumn("rank", rank)


def model_status(metrics: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Completed when every horizon has an RMSE, partial when some do."""
    done = F.count("rmse")
    seen = F.collect_set(F.when(F.col("rmse").isNotNull(), F.col("horizon")))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(h) for h in horizons]), seen))
    return metrics.groupBy("model").agg(
        done.alias("completed_horizons"),
        F.when(done >= len(horizons), "completed").when(done > 0, "partial").otherwise("failed").alias(
            "status"
        ),
        F.array_join(F.transform(missing, lambda h: F.concat(h, F.lit(": no result"))), "; ").alias(
            "warnings"
        ),
    )


FOLD_METRICS = [
    "mae", "rmse", "median_absolute_error", "r2", "bias", "underprediction_rate",
    "overprediction_rate",
]


def fold_summary(df: DataFrame, keys: Sequence[str], baseline: str = "persistence") -> DataFrame:
    """Mean and spread of fold metrics, with wins and gains against the baseline."""
    keys = list(keys)
    by_fold = bias_metrics(df, [*keys, "model", "fold"])
    base = by_fold.where(F.col("model") == baseline).select(
        *keys, "fold", F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse")
    )
    gains = by_fold.join(base, [*keys, "fold"]).withColumns(
        {
            "_gain_mae": F.try_divide(F.col("_mae") - F.col("mae"), F.col("_mae")) * 100,
            "_gain_rmse": F.try_divide(F.col("_rmse") - F.col("rmse"), F.col("_rmse")) * 100,
        }
    )
    return gains.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("folds"),
        *[steady_mean(F.col(m)).alias(f"mean_{m}") for m in FOLD_METRICS],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in FOLD_METRICS],
        F.count_if(F.col("_gain_mae") > 0).alias("mae_fold_wins"),
        F.count_if(F.col("_gain_rmse") > 0).alias("rmse_fold_wins"),
        F.avg("_gain_mae").alias("mean_mae_improvement"),
        F.avg("_gain_rmse").alias("mean_rmse_improvement"),
    )


def _gate_inputs(summary: DataFrame, tails: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    p90 = tails.where(F.col("subset") == "p90").select(
        *keys, "model", F.col("mae").alias("_tail_mae"), F.col("rmse").alias("_tail_rmse"),
        F.col("underprediction_rate").alias("_tail_rate"),
        F.col("mean_underprediction").alias("_tail_mean"),
    )
    rows = summary.join(p90, [*keys, "model"])
    base = rows.where(F.col("model") == baseline).select(
        *keys,
        *[F.col(c).alias(f"_base{c}") for c in ("_tail_mae", "_tail_rmse", "_tail_rate", "_tail_mean")],
        F.col("mean_rmse").alias("_base_rmse"),
    )
    return rows.join(base, keys)


def _gains() -> Column:
    return (
        (F.col("mean_mae_improvement") >= 5.0)
        & (F.col("mean_rmse_improvement") >= 5.0)
        & (F.col("mae_fold_wins") >= 2)
        & (F.col("rmse_fold_wins") >= 2)
    )


def promotion_gate(
    summary: DataFrame,
    tails: DataFrame,
    keys: Sequence[str],
    strict: bool = False,
    baseline: str = "persistence",
) -> DataFrame:
    """Whether each model may replace the baseline, and which one is selected.

    The plain gate asks for gains, fold wins and no worse tail; ``strict`` adds
    fold variance, tail RMSE, tail magnitude and bias limits instead of the rate.
    """
    keys = list(keys)
    rows = _gate_inputs(summary, tails, keys, baseline)
    if strict:
        robust = (
            _gains()
            & (F.col("std_mae") <= F.col("mean_mae") * 0.50)
            & (F.col("std_rmse") <= F.col("mean_rmse") * 0.50)
            & (F.col("_tail_mae") <= F.col("_base_tail_mae") * 1.05)
            & (F.col("_tail_rmse") <= F.col("_base_tail_rmse") * 1.05)
            & (F.col("_tail_mean") <= F.col("_base_tail_mean") * 1.25)
            & (F.abs("mean_bias") <= F.col("_base_rmse") * 0.50)
        )
    else:
        robust = (
            _gains()
            & (F.col("_tail_mae") <= F.col("_base_tail_mae"))
            & (F.col("_tail_rate") <= F.greatest(F.lit(0.75), F.col("_base_tail_rate")))
        )
    learned = F.col("model") != baseline
    order = F.struct(
        F.col("mean_mae"), F.col("mean_rmse"), F.abs("mean_bias").alias("_b"), F.col("model")
    )
    group = Window.partitionBy(*keys)
    gated = rows.withColumn("passes_gate", F.when(learned, robust).otherwise(True))
    best = F.min_by("model", F.when(learned & F.col("passes_gate"), order)).over(group)
    return gated.select(
        *keys,
        "model",
        F.row_number().over(group.orderBy("mean_mae", "mean_rmse", F.abs("mean_bias"), "model")).alias(
            "rank"
        ),
        "passes_gate",
        F.coalesce(best, F.lit(baseline)).alias("selected_model"),
    )


# Weights of the normalised metrics (40 % overall, 40 % high values,
# 20 % stability between sensors).
SCORE_WEIGHTS = {
    "overall_mae": 0.15, "overall_rmse": 0.10, "overall_median_ae": 0.10, "overall_r2": 0.05,
    "p90_mae": 0.12, "p90_rmse": 0.08, "p95_mae": 0.12, "p95_rmse": 0.08,
    "sensor_mean_mae": 0.08, "sensor_worst_mae": 0.07, "sensor_rmse_std": 0.05,
}
SCORE_PARTS = {
    "overall_accuracy_score": (["overall_mae", "overall_rmse", "overall_median_ae", "overall_r2"], 0.40),
    "high_pm_score": (["p90_mae", "p90_rmse", "p95_mae", "p95_rmse"], 0.40),
    "sensor_stability_score": (["sensor_mean_mae", "sensor_worst_mae", "sensor_rmse_std"], 0.20),
}
# Part weights (overall, high values, stability) of each scheme.
WEIGHT_SCHEMES = {
    "balanced_40_40_20": (0.40, 0.40, 0.20),
    "accuracy_focused_50_30_20": (0.50, 0.30, 0.20),
    "health_focused_35_45_20": (0.35, 0.45, 0.20),
    "high_pm_heavy_30_50_20": (0.30, 0.50, 0.20),
    "stability_focused_40_35_25": (0.40, 0.35, 0.25),
}


def metric_table(overall: DataFrame, tails: DataFrame, sensors: DataFrame) -> DataFrame:
    """Overall, high-tail and sensor-stability metrics on (horizon, model).

    Every input has one row per horizon and method or a few, so the joins are
    small whatever the size of the predictions.
    """
    keys = ["horizon", "model"]
    high = tails.groupBy(*keys).pivot("subset", ["p90", "p95"]).agg(
        F.max("mae").alias("mae"), F.max("rmse").alias("rmse")
    )
    stable = sensors.where(F.col("status") == "OK").groupBy(*keys).agg(
        F.avg("mae").alias("sensor_mean_mae"),
        F.max("mae").alias("sensor_worst_mae"),
        F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("sensor_rmse_std"),
    )
    base = overall.select(
        *keys,
        F.col("mae").alias("overall_mae"),
        F.col("rmse").alias("overall_rmse"),
        F.col("median_absolute_error").alias("overall_median_ae"),
        F.col("r2").alias("overall_r2"),
    )
    return base.join(high, keys).join(stable, keys)


def multi_metric_score(table: DataFrame) -> DataFrame:
    """Min-max scores per horizon, weighted parts, final score and rank."""
    group = Window.partitionBy("horizon")

    def score(metric: str) -> Column:
        low, high = F.min(metric).over(group), F.max(metric).over(group)
        flat = F.abs(high - low) <= 1e-8 + 1e-5 * F.abs(low)
        gain = F.col(metric) - low if metric == "overall_r2" else high - F.col(metric)
        return F.when(flat, F.lit(1.0)).otherwise(gain / (high - low))

    scored = table.withColumns({f"{m}_score": score(m) for m in SCORE_WEIGHTS})

    def part(name: str) -> Column:
        metrics, share = SCORE_PARTS[name]
        return sum((F.col(f"{m}_score") * SCORE_WEIGHTS[m] for m in metrics), F.lit(0.0)) / share

    scored = scored.withColumns({name: part(name) for name in SCORE_PARTS})
    final = sum((F.col(n) * share for n, (_, share) in SCORE_PARTS.items()), F.lit(0.0))
    ranked = scored.withColumn("final_score", final)
    order = group.orderBy(F.col("final_score").desc(), "model")
    return ranked.withColumn("final_rank", F.row_number().over(order)).withColumn(
        "final_score_100", F.col("final_score") * 100
    )


def selection_registry(scored: DataFrame) -> DataFrame:
    """Per horizon: the best method, the runner-up and the score gap."""
    order = Window.partitionBy("horizon").orderBy("final_rank")
    return (
        scored.select(
            "horizon",
            F.col("model").alias("selected_model"),
            F.col("final_score").alias("score"),
            F.lead("model").over(order).alias("runner_up"),
            (F.col("final_score") - F.lead("final_score").over(order)).alias("score_gap"),
            "final_rank",
        )
        .where("final_rank = 1")
        .drop("final_rank")
    )


def weight_sensitivity(scored: DataFrame) -> DataFrame:
    """Scores and ranks under every weight scheme."""
    schemes = F.array(
        *[
            F.struct(
                F.lit(name).alias("scheme"),
                sum(
                    (F.col(p) * w for p, w in zip(SCORE_PARTS, weights)), F.lit(0.0)
                ).alias("score"),
            )
            for name, weights in WEIGHT_SCHEMES.items()
        ]
    )
    rows = scored.select("horizon", "model", F.explode(schemes).alias("_s")).select(
        "horizon", "model", "_s.*"
    )
    order = Window.partitionBy("horizon", "scheme").orderBy(F.col("score").desc(), "model")
    return rows.withColumn("rank", F.row_number().over(order))


def robustness(ranked: DataFrame) -> DataFrame:
    """Most frequent winner per horizon and the share of schemes it wins."""
    wins = ranked.where("rank = 1").groupBy("horizon", "model").agg(
        F.count(F.lit(1)).alias("wins")
    )
    return wins.groupBy("horizon").agg(
        F.min_by("model", F.struct(-F.col("wins"), F.col("model"))).alias("most_robust_method"),
        F.max("wins").alias("wins"),
        F.sum("wins").alias("total_schemes"),
        (F.max("wins") / F.sum("wins")).alias("robustness_fraction"),
    )


def prediction_reconcile(fresh: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference of two sets of predictions on their common keys, per horizon."""
    both = fresh.select(*keys, "horizon", F.col("predicted").alias("_a")).join(
        saved.select(*keys, "horizon", F.col("predicted").alias("_b")), [*keys, "horizon"]
    )
    diff = F.col("_a") - F.col("_b")
    n = F.count(F.lit(1))
    return (
        both.where(diff.isNotNull())
        .groupBy("horizon")
        .agg(
            n.alias("rows"),
            F.avg(F.abs(diff)).alias("mean_absolute_difference"),
            F.max(F.abs(diff)).alias("max_absolute_difference"),
            F.avg(diff).alias("mean_signed_difference"),
            (F.count_if(F.abs(diff) <= 1e-6) / n).alias("within_1e_6"),
            (F.count_if(F.abs(diff) <= 1e-4) / n).alias("within_1e_4"),
            (F.count_if(F.abs(diff) <= 1e-2) / n).alias("within_1e_2"),
        )
    )
