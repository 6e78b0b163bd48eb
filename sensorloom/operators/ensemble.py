"""Prediction archives and ensembles of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["ts", "sensor_id", "city", "horizon", "fold", "actual", "actual_health_average"]


def wide_archive(
    predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per key with the three columns of every model: one shuffle, no outer joins."""
    wide = predictions.groupBy(*keys).pivot("model", list(models)).agg(
        F.max("predicted").alias("prediction"),
        F.max("predicted_health_average").alias("health_prediction"),
        F.max(F.col("actual") - F.col("predicted")).alias("residual"),
    )
    names = [
        F.col(f"{m}_{kind}").alias(f"{kind}_{m}")
        for m in models
        for kind in ("prediction", "health_prediction", "residual")
    ]
    return wide.select(*keys, *names)


def strict_rows(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows every model predicted."""
    return wide.na.drop(subset=["actual", *[f"prediction_{m}" for m in models]])


def equal_average(wide: DataFrame, models: Sequence[str], out: str = "predicted") -> DataFrame:
    """Mean over the models that predicted the row."""
    values = F.array_compact(F.array(*[F.col(f"prediction_{m}") for m in models]))
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return wide.withColumn(out, F.when(F.size(values) > 0, total / F.size(values)))


def simplex_weights(
    wide: DataFrame, models: Sequence[str], group: str = "horizon"
) -> DataFrame:
    """Weights on the simplex that minimise RMSE over the strict rows of each group.

    One aggregate gives the Gram matrix and the cross moments; only that small
    matrix per group is optimised, so the size of the archive does not matter.
    """
    import numpy as np

    models = list(models)
    k = len(models)
    rows = strict_rows(wide, models)
    p = [F.col(f"prediction_{m}") for m in models]
    moments = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("actual") * F.col("actual")).alias("_yy"),
        *[F.sum(p[i] * p[j]).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(p[i] * F.col("actual")).alias(f"_c{i}") for i in range(k)],
    )

    def optimise(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                gram = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        gram[i, j] = gram[j, i] = row[f"_g{i}_{j}"]
                cross = np.array([row[f"_c{i}"] for i in range(k)])
                w = minimise_on_simplex(gram, cross)
                sse = row["_yy"] - 2 * w @ cross + w @ gram @ w
                rmse = float(np.sqrt(max(sse, 0.0) / row["n"]))
                out += [(row[group], int(row["n"]), m, float(x), rmse) for m, x in zip(models, w)]
            yield pd.DataFrame(out, columns=[group, "n", "model", "weight", "rmse"])

    kind = dict(wide.dtypes)[group]
    return moments.mapInPandas(
        optimise, f"{group} {kind}, n long, model string, weight double, rmse double"
    )


def minimise_on_simplex(gram, cross, sweeps: int = 2000, tolerance: float = 1e-15):
    """Minimise ``w'Gw - 2c'w`` with non-negative weights that sum to one.

    Moves weight between pairs of models with an exact step until nothing moves.
    """
    import numpy as np

    k = len(cross)
    w = np.full(k, 1.0 / k)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(k):
            for j in range(k):
                if i == j:
                    continue
                slope = (gram[i] - gram[j]) @ w - (cross[i] - cross[j])
                curve = gram[i, i] - 2 * gram[i, j] + gram[j, j]
                if curve <= 0:
                    continue
                step = float(np.clip(-slope / curve, -w[i], w[j]))
                w[i] += step
                w[j] -= step
                moved = max(moved, abs(step))
        if moved <= tolerance:
            break
    return w / w.sum()


def non_negative_least_squares(gram, cross, sweeps: int = 5000):
    """Minimise ``w'Gw - 2c'w`` with non-negative weights, coordinate by coordinate."""
    import numpy as np

    w = np.zeros(len(cross))
    for _ in range(sweeps):
        before = w.copy()
        for i in range(len(cross)):
            if gram[i, i] > 0:
                w[i] = max(0.0, w[i] + (cross[i] - gram[i] @ w) / gram[i, i])
        if np.max(np.abs(w - before)) <= 1e-14:
            break
    return w


def dynamic_weighting(
    wide: DataFrame,
    weights: DataFrame,
    models: Sequence[str],
    group: str = "horizon",
    minimum_models: int = 1,
) -> DataFrame:
    """Weighted prediction over the models present in each row.

    Zero-weight models are inactive, missing active models hand their weight to
    the others, and ``fallback_used`` tells when that happened.
    """
    table = weights.groupBy(group).pivot("model", list(models)).agg(F.max("weight"))
    table = table.select(
        group, F.array(*[F.coalesce(F.col(m), F.lit(0.0)) for m in models]).alias("_w")
    )
    # One row per horizon; AQE broadcasts it.
    rows = wide.join(table, group)
    cells = F.zip_with(
        F.arrays_zip(
            F.array(*[F.lit(m) for m in models]).alias("name"),
            F.array(*[F.col(f"prediction_{m}") for m in models]).alias("value"),
        ),
        F.col("_w"),
        lambda c, w: F.struct(c["name"].alias("name"), c["value"].alias("value"), w.alias("weight")),
    )
    rows = rows.withColumn("_cells", cells)
    active = F.filter("_cells", lambda c: c["weight"] > 1e-12)
    here = F.filter(active, lambda c: c["value"].isNotNull() & ~F.isnan(c["value"]))
    gone = F.filter(active, lambda c: c["value"].isNull() | F.isnan(c["value"]))

    def total(cells: Column, f) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, c: a + f(c))

    enough = F.size(here) >= minimum_models
    mass = total(here, lambda c: c["weight"])
    return rows.select(
        "*",
        F.when(enough, total(here, lambda c: c["weight"] * c["value"]) / mass).alias("predicted"),
        F.array_join(F.transform(gone, lambda c: c["name"]), ",").alias("models_missing"),
        F.when(
            enough,
            F.map_from_entries(
                F.transform(here, lambda c: F.struct(c["name"], c["weight"] / mass))
            ),
        ).alias("effective_weights"),
        (~enough | (F.size(gone) > 0)).alias("fallback_used"),
    ).drop("_w", "_cells")


def stacking(
    wide: DataFrame, models: Sequence[str], split: str = "meta_split"
) -> tuple[DataFrame, DataFrame]:
    """Fit the meta models on meta-train rows and compare them on meta-validation rows.

    Returns (validation RMSE per meta model, predictions of the best one on all
    strict rows).  Each fit is a distributed Spark ML job; the non-negative form
    needs only the Gram matrix.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    from sensorloom.operators.ml import elastic_net, ridge

    spark = wide.sparkSession
    columns = [f"prediction_{m}" for m in models]
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(
        strict_rows(wide, models).withColumn("_label", F.col("actual"))
    )
    train, valid = rows.where(F.col(split) == "meta_train"), rows.where(
        F.col(split) == "meta_validation"
    )
    n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop("_label")).first()
    if n < 100:
        raise ValueError(f"stacking needs 100 aligned meta-train rows, found {n}")
    common = {"featuresCol": "features", "labelCol": "_label"}
    candidates = {
        "linear": LinearRegression(**common),
        "ridge_0.1": ridge(0.1, n, spread),
        "ridge_1": ridge(1.0, n, spread),
        "ridge_10": ridge(10.0, n, spread),
        "elastic_net": elastic_net(0.01, 0.5, spread),
        "forest": RandomForestRegressor(numTrees=50, maxDepth=5, seed=42, **common),
        "boosted": GBTRegressor(maxIter=30, maxDepth=3, seed=42, **common),
    }
    scores, fitted = [], {}
    error = F.col("_label") - F.col("prediction")
    for name, estimator in candidates.items():
        fitted[name] = estimator.fit(train).transform
        rmse = fitted[name](valid).agg(F.sqrt(F.avg(error * error))).first()[0]
        scores.append((name, float(rmse)))
    weights = _nnls_weights(train, columns)
    expr = sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(0.0))
    fitted["non_negative"] = lambda df: df.withColumn("prediction", expr)
    rmse = fitted["non_negative"](valid).agg(F.sqrt(F.avg(error * error))).first()[0]
    scores.append(("non_negative", float(rmse)))
    best = min(scores, key=lambda s: (s[1], s[0]))[0]
    table = spark.createDataFrame(scores, "meta_model string, validation_rmse double")
    predictions = fitted[best](rows).withColumn("meta_model", F.lit(best)).withColumnRenamed(
        "prediction", "predicted"
    )
    return table, predictions.drop("features", "_label")


def _nnls_weights(train: DataFrame, columns: list[str]) -> list[float]:
    import numpy as np

    k = len(columns)
    # k * (k + 3) / 2 numbers, whatever the number of rows.
    row = train.agg(
        *[
            F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}")
            for i in range(k)
            for j in range(i, k)
        ],
        *[F.sum(F.col(c) * F.col("actual")).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    cross = np.array([row[f"c{i}"] for i in range(k)])
    return non_negative_least_squares(gram, cross).tolist()
