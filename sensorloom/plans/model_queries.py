"""Queries over prediction archives, metrics, ensembles and selection.

Three simple models predict every target: persistence, the backward three-hour
mean, and the value one day before the target.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import forecasts as P
from sensorloom.functions.text import alert_id, dedup_key, normalize_horizon, strip_prefix
from sensorloom.operators import ensemble as N
from sensorloom.operators import metrics as M
from sensorloom.operators import ml
from sensorloom.operators import series as S
from sensorloom.plans.feature_queries import SEG, TARGETS, target_table
from sensorloom.plans.network import HOURLY, observations, query_table, rounded, sql
from sensorloom.sources.staging import stage

QUERIES, SQL, query = query_table()

MODELS = ["persistence", "mean3", "seasonal"]
HOURS = (1, 3, 6)
HORIZON_NAMES = [f"{h}h" for h in HOURS]


def predictions(obs):
    """Long archive; one row per reading, horizon and model that could predict it."""
    seasonal = {f"_day_{h}h": ("pm25", -(24 - h) * 60) for h in HOURS}
    rows = S.exact_shifts(target_table(obs), HOURLY, seasonal)
    fold = F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 8) + 1).cast("int")
    cells = []
    for h in HOURS:
        average = F.coalesce("pm25_avg", "pm25")
        values = {
            "persistence": (F.col("pm25"), average),
            "mean3": (F.col("pm25_mean_3h"), F.col("pm25_mean_3h")),
            "seasonal": (F.col(f"_day_{h}h"), F.col(f"_day_{h}h")),
        }
        cells += [
            F.struct(
                F.lit(f"{h}h").alias("horizon"),
                F.lit(name).alias("model"),
                F.col(f"target_pm25_{h}h").alias("actual"),
                predicted.alias("predicted"),
                F.col(f"target_pm25_who_24h_avg_{h}h").alias("actual_health_average"),
                health.alias("predicted_health_average"),
            )
            for name, (predicted, health) in values.items()
        ]
    usable = F.filter(
        F.array(*cells), lambda c: c["actual"].isNotNull() & c["predicted"].isNotNull()
    )
    return rows.select(
        "sensor_id", "city", "ts", fold.alias("fold"), F.explode(usable).alias("_c")
    ).select("sensor_id", "city", "ts", "fold", "_c.*")


def archive(spark, sf):
    return stage(predictions(observations(spark, sf)))


def wide(spark, sf):
    return N.wide_archive(archive(spark, sf), MODELS)


PREDICTED = {"persistence": ("pm25", "coalesce(pm25_avg, pm25)"), "mean3": ("pm25_mean_3h", "pm25_mean_3h")}
PREDS = TARGETS + """,
daily AS (SELECT *, """ + ", ".join(
    f"max(pm25) OVER (PARTITION BY sensor_id, segment ORDER BY ts RANGE BETWEEN INTERVAL {24 - h} HOUR PRECEDING "
    f"AND INTERVAL {24 - h} HOUR PRECEDING) AS day_{h}h" for h in HOURS) + """ FROM targets),
preds AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT sensor_id, city, ts, least(4, (day(ts) - 1) // 8 + 1)::INT AS fold, '{h}h' AS horizon, '{m}' AS model, "
    f"target_pm25_{h}h AS actual, {PREDICTED.get(m, (f'day_{h}h',) * 2)[0]} AS predicted, "
    f"target_pm25_who_24h_avg_{h}h AS actual_health_average, {PREDICTED.get(m, (f'day_{h}h',) * 2)[1]} AS predicted_health_average FROM daily"
    for h in HOURS for m in MODELS) + """) WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
WIDE = PREDS + """,
wide AS (SELECT ts, sensor_id, city, horizon, fold, actual, actual_health_average, """ + ", ".join(
    f"max(predicted) FILTER (model = '{m}') AS prediction_{m}, max(predicted_health_average) FILTER (model = '{m}') AS health_prediction_{m}, "
    f"max(actual - predicted) FILTER (model = '{m}') AS residual_{m}" for m in MODELS) + """
  FROM preds GROUP BY ts, sensor_id, city, horizon, fold, actual, actual_health_average)"""
WIDE_COLS = " ".join(f"{k}_{m}:8" for m in MODELS for k in ("prediction", "health_prediction", "residual"))


@query("combine_predictions", sql(SEG + WIDE, "SELECT * FROM wide", f"actual:8 actual_health_average:8 {WIDE_COLS}"))
def _(spark, sf):
    out = wide(spark, sf)
    return rounded(out, **{c: 8 for c in out.columns})


@query("align_methods", sql(SEG + WIDE, """
SELECT horizon, sensor_id, count(*) AS rows, sum(prediction_persistence - prediction_mean3) AS total FROM wide
WHERE prediction_persistence IS NOT NULL AND prediction_mean3 IS NOT NULL AND prediction_seasonal IS NOT NULL
GROUP BY ALL""", "total"))
def _(spark, sf):
    return rounded(N.strict_rows(wide(spark, sf), MODELS).groupBy("horizon", "sensor_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("prediction_persistence") - F.col("prediction_mean3")).alias("total"),
    ))


@query("persistence_forecast", sql(SEG + PREDS, """
SELECT sensor_id, ts, horizon, predicted, predicted_health_average, actual - predicted AS residual
FROM preds WHERE model = 'persistence'""", "predicted:8 predicted_health_average:8 residual:8"))
def _(spark, sf):
    rows = predictions(observations(spark, sf)).where("model = 'persistence'")
    return rounded(rows.select(
        "sensor_id", "ts", "horizon", "predicted", "predicted_health_average",
        (F.col("actual") - F.col("predicted")).alias("residual"),
    ), predicted=8, predicted_health_average=8, residual=8)


REG = """count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))
       ELSE (sum((actual - predicted) ** 2) = 0)::INT::DOUBLE END AS r2"""
REG2 = """avg(abs((actual - predicted) / actual)) FILTER (abs(actual) >= 1) * 100 AS mape,
  quantile_cont(abs(actual - predicted), 0.5) AS median_absolute_error"""
BIAS = """avg(predicted - actual) AS bias, count(*) FILTER (predicted < actual) AS underprediction_count,
  count(*) FILTER (predicted < actual) / count(*) AS underprediction_rate,
  count(*) FILTER (predicted > actual) AS overprediction_count,
  count(*) FILTER (predicted > actual) / count(*) AS overprediction_rate,
  quantile_cont(abs(actual - predicted), 0.5) AS median_absolute_error"""


def event_sql(keys: str) -> str:
    return f"""
ev0 AS (SELECT {keys}, count(*) AS event_n,
   count(*) FILTER (a > 15 AND p > 15) AS tp, count(*) FILTER (NOT a > 15 AND NOT p > 15) AS tn,
   count(*) FILTER (NOT a > 15 AND p > 15) AS false_positives, count(*) FILTER (a > 15 AND NOT p > 15) AS false_negatives
  FROM (SELECT *, actual_health_average AS a, predicted_health_average AS p FROM preds)
  WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY {keys}),
ev1 AS (SELECT *, tp / nullif(tp + false_positives, 0) AS event_precision, tp / nullif(tp + false_negatives, 0) AS event_recall FROM ev0),
events_m AS (SELECT {keys}, event_n, (tp + tn) / event_n AS event_accuracy, event_precision, event_recall,
   2 * event_precision * event_recall / nullif(event_precision + event_recall, 0) AS event_f1,
   tn / nullif(tn + false_positives, 0) AS event_specificity, false_positives, false_negatives FROM ev1)"""


KEYS = ["horizon", "model"]


@query("regression_metrics", sql(SEG + PREDS, f"SELECT horizon, model, {REG}, {REG2} FROM preds GROUP BY ALL",
       "mae rmse r2 mape median_absolute_error"))
def _(spark, sf):
    return rounded(M.regression_metrics(archive(spark, sf), KEYS))


@query("bias_metrics", sql(SEG + PREDS, f"SELECT horizon, model, {REG}, {BIAS} FROM preds GROUP BY ALL",
       "mae rmse r2 bias underprediction_rate overprediction_rate median_absolute_error"))
def _(spark, sf):
    return rounded(M.bias_metrics(archive(spark, sf), KEYS))


EVENT_COLS = "event_accuracy event_precision event_recall event_f1 event_specificity"


@query("event_metrics", sql(SEG + PREDS + "," + event_sql("horizon, model"), "SELECT * FROM events_m", EVENT_COLS))
def _(spark, sf):
    return rounded(M.event_metrics(predictions(observations(spark, sf)), KEYS))


SENSOR = "," + event_sql("horizon, model, sensor_id") + f""",
sensor_m AS (SELECT horizon, model, sensor_id, n, CASE WHEN n >= 20 THEN 'OK' ELSE 'INSUFFICIENT_TEST_DATA' END AS status,
  """ + ", ".join(f"CASE WHEN n >= 20 THEN {c} END AS {c}" for c in (
    "mae rmse r2 mape median_absolute_error event_n event_accuracy event_precision event_recall event_f1 "
    "event_specificity false_positives false_negatives").split()) + f"""
  FROM (SELECT horizon, model, sensor_id, {REG}, {REG2} FROM preds GROUP BY ALL) LEFT JOIN events_m USING (horizon, model, sensor_id))"""


@query("sensor_metrics", sql(SEG + PREDS + SENSOR, "SELECT * FROM sensor_m",
       "mae rmse r2 mape median_absolute_error " + EVENT_COLS))
def _(spark, sf):
    return rounded(M.sensor_metrics(archive(spark, sf), KEYS))


TAIL = """,
limits AS (SELECT horizon, quantile_cont(actual, 0.9) AS p90, quantile_cont(actual, 0.95) AS p95 FROM preds GROUP BY ALL),
tail AS (SELECT preds.*, 'p90' AS subset, p90 AS threshold FROM preds JOIN limits USING (horizon) WHERE actual >= p90
         UNION ALL SELECT preds.*, 'p95', p95 FROM preds JOIN limits USING (horizon) WHERE actual >= p95)"""
UNDER = """count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  avg(predicted - actual) AS bias, count(*) FILTER (predicted < actual) AS underprediction_count,
  count(*) FILTER (predicted < actual) / count(*) AS underprediction_rate,
  coalesce(avg(actual - predicted) FILTER (predicted < actual), 0) AS mean_underprediction,
  coalesce(max(actual - predicted) FILTER (predicted < actual), 0) AS worst_underprediction"""
UNDER_COLS = "mae rmse bias underprediction_rate mean_underprediction worst_underprediction"


@query("tail_thresholds", sql(SEG + PREDS + TAIL, "SELECT * FROM limits", "p90 p95"))
def _(spark, sf):
    return rounded(M.tail_thresholds(archive(spark, sf), ["horizon"]))


@query("residual_margin", sql(SEG + PREDS, """
SELECT horizon, model, quantile_cont(greatest(actual - predicted, 0), 0.95) AS safety_margin FROM preds GROUP BY ALL""", "safety_margin"))
def _(spark, sf):
    return rounded(M.residual_margin(archive(spark, sf), KEYS))


@query("high_tail_metrics", sql(SEG + PREDS + TAIL, f"""
SELECT horizon, model, subset, threshold, {UNDER} FROM tail GROUP BY ALL""", "threshold " + UNDER_COLS))
def _(spark, sf):
    return rounded(M.high_tail_metrics(archive(spark, sf), KEYS))


ALL_TAILS = TAIL + """,
subsets AS (SELECT *, 'all' AS subset, NULL AS threshold FROM preds UNION ALL SELECT * FROM tail)"""


@query("underprediction_analysis", sql(SEG + PREDS + ALL_TAILS, f"""
SELECT horizon, model, subset, {UNDER} FROM subsets GROUP BY ALL""", UNDER_COLS))
def _(spark, sf):
    return rounded(M.underprediction_analysis(archive(spark, sf), KEYS))


@query("underprediction_by_sensor", sql(SEG + PREDS + TAIL, f"""
SELECT horizon, model, sensor_id, {UNDER} FROM tail WHERE subset = 'p95' GROUP BY ALL""", " ".join(f"{c}:8" for c in UNDER_COLS.split())))
def _(spark, sf):
    table = M.high_tail_metrics(archive(spark, sf), [*KEYS, "sensor_id"]).where("subset = 'p95'")
    return rounded(table.drop("subset", "threshold"), **{c: 8 for c in UNDER_COLS.split()})


@query("safest_methods", sql(SEG + PREDS + ALL_TAILS, f""",
u AS (SELECT horizon, model, subset, {UNDER} FROM subsets GROUP BY ALL)
SELECT horizon, subset, arg_min(model, (round(underprediction_rate, 9), model)) AS safest_by_rate,
       arg_min(model, (round(mean_underprediction, 9), model)) AS safest_by_mean,
       arg_min(model, (round(worst_underprediction, 9), model)) AS safest_by_worst FROM u GROUP BY ALL"""))
def _(spark, sf):
    table = M.underprediction_analysis(archive(spark, sf), KEYS)
    return M.safest_methods(rounded(
        table, underprediction_rate=9, mean_underprediction=9, worst_underprediction=9
    ))


@query("model_diversity", sql(SEG + WIDE, """,
mp AS (""" + " UNION ALL ".join(
    f"SELECT horizon, '{a}' AS model_a, '{b}' AS model_b, prediction_{a} AS pa, prediction_{b} AS pb, residual_{a} AS ra, residual_{b} AS rb "
    f"FROM wide WHERE prediction_{a} IS NOT NULL AND prediction_{b} IS NOT NULL"
    for i, a in enumerate(MODELS) for b in MODELS[i + 1:]) + """),
q AS (SELECT horizon, model_a, model_b, quantile_cont(abs(ra), 0.75) AS qa, quantile_cont(abs(rb), 0.75) AS qb FROM mp GROUP BY ALL)
SELECT horizon, model_a, model_b, count(*) AS overlap, corr(pa, pb) AS prediction_correlation, corr(ra, rb) AS residual_correlation,
       count(*) FILTER (abs(ra) >= qa AND abs(rb) >= qb) AS both_large_error_count FROM mp JOIN q USING (horizon, model_a, model_b) GROUP BY ALL""",
    "prediction_correlation residual_correlation"))
def _(spark, sf):
    return rounded(M.model_diversity(wide(spark, sf), MODELS))


def overall(rows):
    return M.regression_metrics(rows, KEYS).join(M.event_metrics(rows, KEYS), KEYS, "left")


OVERALL = "," + event_sql("horizon, model") + f""",
overall AS (SELECT * FROM (SELECT horizon, model, {REG}, {REG2} FROM preds GROUP BY ALL) LEFT JOIN events_m USING (horizon, model))"""


@query("leaderboard", sql(SEG + PREDS + OVERALL, """,
b AS (SELECT horizon, model, unnest(['rmse', 'mae', 'r2', 'event_recall', 'event_f1']) AS metric,
             unnest([round(rmse, 9), round(mae, 9), round(r2, 9), round(event_recall, 9), round(event_f1, 9)]) AS value FROM overall)
SELECT horizon, model, metric, round(value, 6) AS value, row_number() OVER (PARTITION BY horizon, metric
       ORDER BY CASE WHEN metric IN ('rmse', 'mae') THEN value ELSE -value END, model)::INT AS rank
FROM b WHERE value IS NOT NULL"""))
def _(spark, sf):
    table = overall(archive(spark, sf))
    nine = {c: 9 for c in M.LOWER_IS_BETTER}
    return rounded(M.leaderboard(rounded(table, **nine)))


@query("model_status", sql(SEG + PREDS + OVERALL, """
SELECT model, count(rmse) AS completed_horizons,
       CASE WHEN count(rmse) >= 4 THEN 'completed' WHEN count(rmse) > 0 THEN 'partial' ELSE 'failed' END AS status,
       array_to_string([h || ': no result' for h in ['12h', '1h', '3h', '6h'] if NOT list_contains(list(horizon) FILTER (rmse IS NOT NULL), h)], '; ') AS warnings
FROM overall GROUP BY model"""))
def _(spark, sf):
    return M.model_status(overall(archive(spark, sf)), [*HORIZON_NAMES, "12h"])


FOLDS = f""",
fm AS (SELECT horizon, model, fold, {REG}, {BIAS} FROM preds GROUP BY ALL),
fg AS (SELECT fm.*, (b.mae - fm.mae) / b.mae * 100 AS gm, (b.rmse - fm.rmse) / b.rmse * 100 AS gr
       FROM fm JOIN (SELECT horizon, fold, mae, rmse FROM fm WHERE model = 'persistence') b USING (horizon, fold)),
fs AS (SELECT horizon, model, count(*) AS folds, """ + ", ".join(
    [f"avg({m}) AS mean_{m}" for m in M.FOLD_METRICS] + [f"stddev_pop({m}) AS std_{m}" for m in M.FOLD_METRICS]) + """,
   count(*) FILTER (gm > 0) AS mae_fold_wins, count(*) FILTER (gr > 0) AS rmse_fold_wins,
   avg(gm) AS mean_mae_improvement, avg(gr) AS mean_rmse_improvement FROM fg GROUP BY ALL)"""
FOLD_COLS = " ".join([f"mean_{m} std_{m}" for m in M.FOLD_METRICS] + ["mean_mae_improvement mean_rmse_improvement"])


@query("fold_summary", sql(SEG + PREDS + FOLDS, "SELECT * FROM fs", FOLD_COLS))
def _(spark, sf):
    return rounded(M.fold_summary(archive(spark, sf), ["horizon"]))


def gate_sql(condition: str) -> str:
    return f""",
t90 AS (SELECT horizon, model, {UNDER} FROM tail WHERE subset = 'p90' GROUP BY ALL),
g AS (SELECT fs.*, t.mae AS tm, t.rmse AS tr, t.underprediction_rate AS tu, t.mean_underprediction AS tw
      FROM fs JOIN t90 t USING (horizon, model)),
gb AS (SELECT g.*, b.tm AS btm, b.tr AS btr, b.tu AS btu, b.tw AS btw, b.mean_rmse AS brmse
       FROM g JOIN (SELECT * FROM g WHERE model = 'persistence') b USING (horizon)),
gp AS (SELECT *, CASE WHEN model = 'persistence' THEN true ELSE mean_mae_improvement >= 5 AND mean_rmse_improvement >= 5
       AND mae_fold_wins >= 2 AND rmse_fold_wins >= 2 AND {condition} END AS passes_gate FROM gb)
SELECT horizon, model, row_number() OVER (PARTITION BY horizon ORDER BY mean_mae, mean_rmse, abs(mean_bias), model)::INT AS rank,
  passes_gate, coalesce(arg_min(model, (mean_mae, mean_rmse, abs(mean_bias))) FILTER (passes_gate AND model <> 'persistence')
    OVER (PARTITION BY horizon), 'persistence') AS selected_model FROM gp"""


@query("promotion_gate", sql(SEG + PREDS + FOLDS + TAIL, gate_sql("tm <= btm AND tu <= greatest(0.75, btu)")))
def _(spark, sf):
    rows = archive(spark, sf)
    summary = M.fold_summary(rows, ["horizon"])
    return M.promotion_gate(summary, M.high_tail_metrics(rows, KEYS), ["horizon"])


@query("promotion_gate_strict", sql(SEG + PREDS + FOLDS + TAIL, gate_sql(
    "std_mae <= mean_mae * 0.5 AND std_rmse <= mean_rmse * 0.5 AND tm <= btm * 1.05 AND tr <= btr * 1.05 "
    "AND tw <= btw * 1.25 AND abs(mean_bias) <= brmse * 0.5")))
def _(spark, sf):
    rows = archive(spark, sf)
    summary = M.fold_summary(rows, ["horizon"])
    return M.promotion_gate(summary, M.high_tail_metrics(rows, KEYS), ["horizon"], strict=True)


def metric_table(spark, sf):
    rows = archive(spark, sf)
    return M.metric_table(
        M.regression_metrics(rows, KEYS), M.high_tail_metrics(rows, KEYS), M.sensor_metrics(rows, KEYS)
    )


METRIC_TABLE = OVERALL.replace("ev0", "xv0").replace("ev1", "xv1").replace("events_m", "xevents") + TAIL + SENSOR + f""",
th AS (SELECT horizon, model, subset, {UNDER} FROM tail GROUP BY ALL),
mt AS (SELECT o.horizon, o.model, o.mae AS overall_mae, o.rmse AS overall_rmse, o.median_absolute_error AS overall_median_ae,
   o.r2 AS overall_r2, p90_mae, p90_rmse, p95_mae, p95_rmse, sensor_mean_mae, sensor_worst_mae, sensor_rmse_std
  FROM overall o JOIN (SELECT horizon, model, max(mae) FILTER (subset = 'p90') AS p90_mae, max(rmse) FILTER (subset = 'p90') AS p90_rmse,
     max(mae) FILTER (subset = 'p95') AS p95_mae, max(rmse) FILTER (subset = 'p95') AS p95_rmse FROM th GROUP BY ALL) USING (horizon, model)
  JOIN (SELECT horizon, model, avg(mae) AS sensor_mean_mae, max(mae) AS sensor_worst_mae, coalesce(stddev_samp(rmse), 0) AS sensor_rmse_std
        FROM sensor_m WHERE status = 'OK' GROUP BY ALL) USING (horizon, model))"""


def _score_sql(m: str) -> str:
    low, high = f"min({m}) OVER h", f"max({m}) OVER h"
    gain = f"{m} - {low}" if m == "overall_r2" else f"{high} - {m}"
    return f"CASE WHEN abs({high} - {low}) <= 1e-8 + 1e-5 * abs({low}) THEN 1.0::DOUBLE ELSE ({gain}) / ({high} - {low}) END AS {m}_score"


SCORED = METRIC_TABLE + """,
sc0 AS (SELECT *, """ + ", ".join(_score_sql(m) for m in M.SCORE_WEIGHTS) + """ FROM mt WINDOW h AS (PARTITION BY horizon)),
sc1 AS (SELECT *, """ + ", ".join(
    "(" + " + ".join(f"{m}_score * {M.SCORE_WEIGHTS[m]}::DOUBLE" for m in ms) + f") / {share}::DOUBLE AS {name}"
    for name, (ms, share) in M.SCORE_PARTS.items()) + """ FROM sc0),
scored AS (SELECT *, """ + " + ".join(f"{n} * {share}::DOUBLE" for n, (_, share) in M.SCORE_PARTS.items()) + """ AS final_score,
  row_number() OVER (PARTITION BY horizon ORDER BY final_score DESC, model)::INT AS final_rank, final_score * 100 AS final_score_100 FROM sc1)"""
MT_COLS = " ".join(M.SCORE_WEIGHTS)


@query("metric_table_join", sql(SEG + PREDS + METRIC_TABLE, "SELECT * FROM mt", MT_COLS))
def _(spark, sf):
    return rounded(metric_table(spark, sf))


@query("multi_metric_score", sql(SEG + PREDS + SCORED, f"""
SELECT horizon, model, {', '.join(M.SCORE_PARTS)}, final_score, final_rank, final_score_100 FROM scored""",
    " ".join(M.SCORE_PARTS) + " final_score final_score_100"))
def _(spark, sf):
    out = M.multi_metric_score(metric_table(spark, sf))
    return rounded(out.select(
        "horizon", "model", *M.SCORE_PARTS, "final_score", "final_rank", "final_score_100"
    ))


@query("selection_registry", sql(SEG + PREDS + SCORED, """
SELECT horizon, model AS selected_model, final_score AS score, runner_up, score_gap FROM (
  SELECT *, lead(model) OVER w AS runner_up, final_score - lead(final_score) OVER w AS score_gap FROM scored
  WINDOW w AS (PARTITION BY horizon ORDER BY final_rank)) WHERE final_rank = 1""", "score score_gap"))
def _(spark, sf):
    return rounded(M.selection_registry(M.multi_metric_score(metric_table(spark, sf))))


SENSITIVITY = SCORED + """,
sens AS (SELECT *, row_number() OVER (PARTITION BY horizon, scheme ORDER BY score DESC, model)::INT AS rank FROM (""" + " UNION ALL ".join(
    f"SELECT horizon, model, '{name}' AS scheme, " + " + ".join(f"{p} * {w}::DOUBLE" for p, w in zip(M.SCORE_PARTS, ws)) + " AS score FROM scored"
    for name, ws in M.WEIGHT_SCHEMES.items()) + "))"


@query("weight_sensitivity", sql(SEG + PREDS + SENSITIVITY, "SELECT * FROM sens", "score"))
def _(spark, sf):
    return rounded(M.weight_sensitivity(M.multi_metric_score(metric_table(spark, sf))))


@query("weight_robustness", sql(SEG + PREDS + SENSITIVITY, """,
wins AS (SELECT horizon, model, count(*) AS wins FROM sens WHERE rank = 1 GROUP BY ALL)
SELECT horizon, arg_min(model, (-wins, model)) AS most_robust_method, max(wins) AS wins, sum(wins)::BIGINT AS total_schemes,
       max(wins) / sum(wins) AS robustness_fraction FROM wins GROUP BY ALL"""))
def _(spark, sf):
    return M.robustness(M.weight_sensitivity(M.multi_metric_score(metric_table(spark, sf))))


@query("equal_average", sql(SEG + WIDE, """
SELECT ts, sensor_id, horizon, list_avg(list_filter([prediction_persistence, prediction_mean3, prediction_seasonal], lambda x: x IS NOT NULL)) AS predicted
FROM wide""", "predicted:8"))
def _(spark, sf):
    out = N.equal_average(wide(spark, sf), MODELS)
    return rounded(out.select("ts", "sensor_id", "horizon", "predicted"), predicted=8)


SIMPLEX = WIDE + """,
st AS (SELECT horizon, prediction_persistence AS a, prediction_mean3 AS b, prediction_seasonal AS c, actual AS y FROM wide
       WHERE prediction_persistence IS NOT NULL AND prediction_mean3 IS NOT NULL AND prediction_seasonal IS NOT NULL),
mo AS (SELECT horizon, count(*) AS n, sum((a-c)*(a-c)) AS s11, sum((a-c)*(b-c)) AS s12, sum((b-c)*(b-c)) AS s22,
              sum((a-c)*(y-c)) AS r1, sum((b-c)*(y-c)) AS r2, sum((y-c)*(y-c)) AS q FROM st GROUP BY ALL),
cand AS (
  SELECT *, least(1, greatest(0, r1 / s11)) AS wa, 0.0::DOUBLE AS wb FROM mo UNION ALL
  SELECT *, 0.0, least(1, greatest(0, r2 / s22)) FROM mo UNION ALL
  SELECT * EXCLUDE (w), w, 1 - w FROM (SELECT *, least(1, greatest(0, (r1 - r2 - s12 + s22) / (s11 - 2 * s12 + s22))) AS w FROM mo) UNION ALL
  SELECT * FROM (SELECT *, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) AS wa, (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) AS wb FROM mo)
  WHERE wa >= 0 AND wb >= 0 AND wa + wb <= 1),
simplex AS (SELECT horizon, n, wa, wb, 1 - wa - wb AS wc, sqrt((q - 2 * (wa * r1 + wb * r2) + wa * wa * s11 + 2 * wa * wb * s12 + wb * wb * s22) / n) AS rmse
       FROM cand QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY q - 2 * (wa * r1 + wb * r2) + wa * wa * s11 + 2 * wa * wb * s12 + wb * wb * s22) = 1)"""


@query("weighted_ensemble", sql(SEG + SIMPLEX, """
SELECT horizon, n, unnest(['persistence', 'mean3', 'seasonal']) AS model, round(unnest([wa, wb, wc]), 5) + 0.0::DOUBLE AS weight, round(rmse, 6) AS rmse FROM simplex"""))
def _(spark, sf):
    out = N.simplex_weights(wide(spark, sf), MODELS)
    return rounded(out, weight=5)


@query("dynamic_weighting", sql(SEG + WIDE, """,
d AS (SELECT *, CASE WHEN prediction_persistence IS NULL THEN 0 ELSE 0.3 END + CASE WHEN prediction_mean3 IS NULL THEN 0 ELSE 0.7 END AS mass FROM wide)
SELECT ts, sensor_id, horizon, (coalesce(prediction_persistence * 0.3, 0) + coalesce(prediction_mean3 * 0.7, 0)) / nullif(mass, 0) AS predicted,
       concat_ws(',', CASE WHEN prediction_persistence IS NULL THEN 'persistence' END, CASE WHEN prediction_mean3 IS NULL THEN 'mean3' END) AS models_missing,
       prediction_persistence IS NULL OR prediction_mean3 IS NULL AS fallback_used FROM d""", "predicted:8"))
def _(spark, sf):
    rows = wide(spark, sf)
    weights = rows.select("horizon").distinct().select(
        "horizon",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight"))
            for m, w in zip(MODELS, (0.3, 0.7, 0.0))
        ])).alias("_w"),
    ).select("horizon", "_w.*")
    out = N.dynamic_weighting(rows, weights, MODELS)
    return rounded(
        out.select("ts", "sensor_id", "horizon", "predicted", "models_missing", "fallback_used"),
        predicted=8,
    )


@query("deployable_compare_join", sql(SEG + PREDS + """,
j AS (SELECT horizon, o.ts, o.sensor_id, o.actual, o.predicted AS original, c.predicted AS causal
      FROM (SELECT * FROM preds WHERE model = 'mean3') o JOIN (SELECT * FROM preds WHERE model = 'persistence') c USING (horizon, ts, sensor_id)),
m AS (SELECT horizon, unnest(['original', 'causal']) AS model, actual, unnest([original, causal]) AS predicted FROM j)""", f"""
SELECT horizon, model, {REG} FROM m GROUP BY ALL""", "mae rmse r2"))
def _(spark, sf):
    rows = archive(spark, sf)
    on = ["horizon", "ts", "sensor_id"]
    original = rows.where("model = 'mean3'").select(*on, "actual", F.col("predicted").alias("original"))
    causal = rows.where("model = 'persistence'").select(*on, F.col("predicted").alias("causal"))
    both = original.join(causal, on).unpivot(
        [*on, "actual"], ["original", "causal"], "model", "predicted"
    )
    return rounded(M.regression_metrics(both, KEYS).drop("mape", "median_absolute_error"))


@query("prediction_reconcile", sql(SEG + PREDS, """,
j AS (SELECT horizon, f.predicted - s.predicted AS d FROM (SELECT * FROM preds WHERE model = 'persistence') f
      JOIN (SELECT * FROM preds WHERE model = 'mean3') s USING (horizon, sensor_id, ts))
SELECT horizon, count(*) AS rows, avg(abs(d)) AS mean_absolute_difference, max(abs(d)) AS max_absolute_difference, avg(d) AS mean_signed_difference,
       count(*) FILTER (abs(d) <= 1e-6) / count(*) AS within_1e_6, count(*) FILTER (abs(d) <= 1e-4) / count(*) AS within_1e_4,
       count(*) FILTER (abs(d) <= 1e-2) / count(*) AS within_1e_2 FROM j GROUP BY ALL""",
    "mean_absolute_difference max_absolute_difference mean_signed_difference within_1e_6 within_1e_4 within_1e_2"))
def _(spark, sf):
    rows = archive(spark, sf)
    return rounded(M.prediction_reconcile(
        rows.where("model = 'persistence'"), rows.where("model = 'mean3'"), ["sensor_id", "ts"]
    ))


AQI_SQL = "CASE " + " ".join(
    f"WHEN c BETWEEN {lo} AND {hi} THEN round_even({(ih - il) / (hi - lo)!r}::DOUBLE * (c - {lo}::DOUBLE) + {il}, 0)::INT"
    for lo, hi, il, ih, _ in P.AQI_BANDS) + " ELSE 500 END"
AQI_CAT = "CASE " + " ".join(f"WHEN c BETWEEN {lo} AND {hi} THEN '{cat}'" for lo, hi, _, _, cat in P.AQI_BANDS) + " ELSE 'Hazardous' END"


@query("epa_aqi", sql(SEG, f"""
SELECT sensor_id, ts, c AS concentration, {AQI_SQL} AS aqi, {AQI_CAT} AS category
FROM (SELECT *, greatest(0, floor(aqi * 10.0::DOUBLE) / 10.0::DOUBLE) AS c FROM seg)"""))
def _(spark, sf):
    obs = observations(spark, sf).withColumn("_a", P.epa_aqi(F.col("aqi")))
    return obs.select("sensor_id", "ts", "_a.concentration", "_a.aqi", "_a.category")


@query("who_interpret", sql(SEG, """
SELECT sensor_id, ts, pm25 / 15.0::DOUBLE AS ratio_to_guideline, CASE WHEN pm25 <= 15 THEN 'Meets WHO Guideline' ELSE 'Above WHO Guideline' END AS status
FROM seg""", "ratio_to_guideline"))
def _(spark, sf):
    obs = observations(spark, sf).withColumn("_w", P.who_interpret(F.col("pm25")))
    return rounded(obs.select("sensor_id", "ts", "_w.ratio_to_guideline", "_w.status"))


def forecasts(spark, sf):
    """Persistence forecasts with margin and tail thresholds of their horizon."""
    rows = archive(spark, sf).where("model = 'persistence'")
    margins = M.residual_margin(rows, ["horizon"])
    limits = M.tail_thresholds(rows, ["horizon"])
    # One row per horizon each; AQE broadcasts them.
    return rows.join(margins, "horizon").join(limits, "horizon").withColumn(
        "record",
        P.forecast_record(
            F.col("predicted"), F.col("predicted_health_average"), F.col("safety_margin"),
            F.col("p90"), F.col("p95"),
        ),
    )


FORECASTS = PREDS + f""",
base AS (SELECT * FROM preds WHERE model = 'persistence'),
lim AS (SELECT horizon, quantile_cont(greatest(actual - predicted, 0), 0.95) AS safety_margin, quantile_cont(actual, 0.9) AS p90,
               quantile_cont(actual, 0.95) AS p95 FROM base GROUP BY ALL),
fc AS (SELECT sensor_id, city, ts, horizon, predicted AS forecast, predicted + safety_margin AS safety_upper_estimate, safety_margin,
   predicted_health_average AS future_24h_average,
   CASE WHEN predicted >= p95 THEN 'High' WHEN predicted >= p90 THEN 'Elevated' ELSE 'Normal' END AS point_level,
   CASE WHEN predicted + safety_margin >= p95 THEN 'High' WHEN predicted + safety_margin >= p90 THEN 'Elevated' ELSE 'Normal' END AS risk_level,
   CASE WHEN predicted_health_average <= 15 THEN 'Meets WHO Guideline' ELSE 'Above WHO Guideline' END AS who_status,
   predicted_health_average / 15 AS ratio_to_guideline,
   greatest(0, floor(predicted_health_average * 10.0::DOUBLE) / 10.0::DOUBLE) AS c
  FROM base JOIN lim USING (horizon)),
report AS (SELECT * EXCLUDE (c), {AQI_SQL} AS aqi, {AQI_CAT} AS aqi_category,
  CASE WHEN point_level = 'Normal' AND risk_level IN ('Elevated', 'High') THEN 'only the upper estimate passes a historical bound'
       WHEN point_level = 'Elevated' AND risk_level = 'High' THEN 'the margin lifts the level by one step'
       ELSE 'point and upper estimate agree' END AS trigger FROM fc)"""


@query("risk_level", sql(SEG + FORECASTS, "SELECT sensor_id, ts, horizon, point_level, risk_level, trigger FROM report"))
def _(spark, sf):
    return forecasts(spark, sf).select(
        "sensor_id", "ts", "horizon", "record.high_pm_risk.point_level",
        F.col("record.high_pm_risk.level").alias("risk_level"), "record.high_pm_risk.trigger",
    )


@query("safety_upper", sql(SEG + FORECASTS, """
SELECT sensor_id, ts, horizon, forecast, safety_upper_estimate, safety_margin FROM report""",
    "forecast safety_upper_estimate safety_margin"))
def _(spark, sf):
    return rounded(forecasts(spark, sf).select("sensor_id", "ts", "horizon", "record.pm25.*"))


def report(spark, sf):
    return forecasts(spark, sf).select(
        "sensor_id", "city", "ts", "horizon", "record.pm25.*", "record.future_24h_average",
        F.col("record.high_pm_risk.point_level").alias("point_level"),
        F.col("record.high_pm_risk.level").alias("risk_level"),
        F.col("record.who.status").alias("who_status"),
        F.col("record.who.ratio_to_guideline").alias("ratio_to_guideline"),
        F.col("record.aqi.aqi").alias("aqi"),
        F.col("record.aqi.category").alias("aqi_category"),
        F.col("record.high_pm_risk.trigger").alias("trigger"),
    )


@query("forecast_report", sql(SEG + FORECASTS, "SELECT * FROM report",
       "forecast safety_upper_estimate safety_margin future_24h_average:8 ratio_to_guideline:8"))
def _(spark, sf):
    return rounded(report(spark, sf), future_24h_average=8, ratio_to_guideline=8)


@query("forecast_lookup_replay", sql(SEG + WIDE, """,
choice(horizon, model) AS (VALUES ('1h', 'seasonal'), ('3h', 'mean3'), ('6h', 'persistence')),
stream AS (SELECT DISTINCT ts, sensor_id FROM preds),
chosen AS (SELECT preds.* FROM preds JOIN choice USING (horizon, model)),
rep AS (SELECT s.ts, s.sensor_id, c.horizon, c.model, p.predicted FROM stream s CROSS JOIN choice c
        LEFT JOIN chosen p ON p.ts = s.ts AND p.sensor_id = s.sensor_id AND p.horizon = c.horizon)
SELECT horizon, model, count(*) AS readings, count(predicted) AS ok, count(*) - count(predicted) AS missing FROM rep GROUP BY ALL"""))
def _(spark, sf):
    from sensorloom.operators.serving import forecast_lookup_replay

    rows = archive(spark, sf)
    choice = {"1h": "seasonal", "3h": "mean3", "6h": "persistence"}
    return forecast_lookup_replay(rows, choice).groupBy("horizon", "model").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )


@query("observation_stream", sql(SEG + PREDS, "SELECT DISTINCT ts, sensor_id, city FROM preds"))
def _(spark, sf):
    from sensorloom.operators.serving import observation_stream

    return observation_stream(predictions(observations(spark, sf)))


@query("latency_accuracy_summary", sql(SEG + PREDS, f"""
SELECT model, horizon, {REG}, {REG2} FROM preds GROUP BY ALL""", "mae rmse r2 mape median_absolute_error"))
def _(spark, sf):
    return rounded(M.regression_metrics(archive(spark, sf), ["model", "horizon"]))


@query("horizon_normalize", sql(SEG + PREDS, """,
spelled AS (SELECT CASE fold WHEN 1 THEN horizon WHEN 2 THEN replace(horizon, 'h', ' hours') WHEN 3 THEN replace(horizon, 'h', '') ELSE upper(horizon) || ' ' END AS raw, horizon FROM preds)
SELECT raw, horizon AS normal, 'prediction_' || raw AS column_name, count(*) AS rows FROM spelled GROUP BY ALL"""))
def _(spark, sf):
    h, fold = F.col("horizon"), F.col("fold")
    raw = (
        F.when(fold == 1, h)
        .when(fold == 2, F.replace(h, F.lit("h"), F.lit(" hours")))
        .when(fold == 3, F.replace(h, F.lit("h"), F.lit("")))
        .otherwise(F.concat(F.upper(h), F.lit(" ")))
    )
    rows = predictions(observations(spark, sf)).select(raw.alias("raw"))
    column = F.concat(F.lit("prediction_"), "raw")
    return rows.groupBy(
        strip_prefix(column, "prediction_").alias("raw"), normalize_horizon(F.col("raw")).alias("normal"),
        column.alias("column_name"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("alert_identifier", sql(SEG + PREDS, """,
k AS (SELECT DISTINCT sensor_id || ':high_pm_risk:' || horizon || ':pm25' AS dedup_key, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM preds)
SELECT dedup_key, created_at, 'alert_' || substr(sha256(dedup_key || '|' || created_at), 1, 16) AS id FROM k"""))
def _(spark, sf):
    rows = predictions(observations(spark, sf)).select(
        dedup_key(F.col("sensor_id"), F.lit("high_pm_risk"), F.col("horizon"), F.lit("pm25")).alias("dedup_key"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"),
    ).distinct()
    return rows.withColumn("id", alert_id(F.col("dedup_key"), F.col("created_at")))


@query("meta_split", sql(SEG + WIDE, """
SELECT horizon, ts, sensor_id, CASE WHEN row_number() OVER w - 1 < floor(0.75 * count(*) OVER (PARTITION BY horizon)) THEN 'meta_train' ELSE 'meta_validation' END AS meta_split
FROM wide WINDOW w AS (PARTITION BY horizon ORDER BY ts, sensor_id)"""))
def _(spark, sf):
    return ml.meta_split(wide(spark, sf), ["horizon"], "ts").select(
        "horizon", "ts", "sensor_id", "meta_split"
    )


@query("stacking")
def _(spark, sf):
    rows = stage(ml.meta_split(wide(spark, sf).where("horizon = '1h'"), ["horizon"], "ts"))
    table, predicted = N.stacking(rows, MODELS)
    summary = predicted.groupBy("meta_model", "meta_split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"),
    )
    return table.join(summary, "meta_model", "left")


@query("error_overlap", sql(SEG + WIDE, """,
e AS (SELECT horizon, abs(residual_persistence) AS a, abs(residual_mean3) AS b FROM wide WHERE prediction_persistence IS NOT NULL AND prediction_mean3 IS NOT NULL),
q AS (SELECT horizon, quantile_cont(a, 0.75) AS qa, quantile_cont(b, 0.75) AS qb FROM e GROUP BY ALL)
SELECT horizon, count(*) AS overlap, count(*) FILTER (a >= qa AND b >= qb) AS both_large_error_count FROM e JOIN q USING (horizon) GROUP BY ALL"""))
def _(spark, sf):
    table = M.model_diversity(wide(spark, sf), ["persistence", "mean3"])
    return table.select("horizon", "overlap", "both_large_error_count")
