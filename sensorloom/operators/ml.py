"""Splits, model fitting and evaluation tables, through Spark ML and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, finite
from sensorloom.functions.rows import single_row
from sensorloom.operators.series import Series, micros, with_ordinal
from sensorloom.sources.staging import stage


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key repeats on either side.

    The guard is part of the plan: each side carries its key count, and a count
    above one raises when the row is produced, so no separate job runs.
    """
    keys = list(keys)

    def guarded(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        # A key that occurs once keeps its own row; max over one row is that row.
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"_{side}"), *[F.max(c).alias(c) for c in rest]
        )

    joined = guarded(left, "l").join(guarded(right, "r"), keys)
    repeated = (F.col("_l") > 1) | (F.col("_r") > 1)
    checked = joined.withColumn(
        keys[0],
        F.when(repeated, F.raise_error(F.lit("join keys are not unique")).cast(
            joined.schema[keys[0]].dataType
        )).otherwise(F.col(keys[0])),
    )
    return checked.drop("_l", "_r")


def chronological_split(ts: str, train_end: str, valid_end: str, test_end: str) -> Column:
    """Name of the split a row falls into; null after the test period."""
    t = F.col(ts)
    return (
        F.when(t < F.lit(train_end).cast("timestamp_ntz"), "train")
        .when(t < F.lit(valid_end).cast("timestamp_ntz"), "validation")
        .when(t < F.lit(test_end).cast("timestamp_ntz"), "test")
    )


def expanding_folds(
    df: DataFrame, ts: str, folds: Sequence[tuple[str, str]]
) -> DataFrame:
    """Rows per fold with their role: train before the start, validate inside it."""
    rows = []
    for i, (start, end) in enumerate(folds, 1):
        a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        role = F.when(F.col(ts) < a, "train").when(F.col(ts) < b, "validation")
        rows.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    return (
        df.withColumn("_f", F.explode(F.array(*rows)))
        .where(F.col("_f.role").isNotNull())
        .select("*", "_f.fold", "_f.role")
        .drop("_f")
    )


def meta_split(df: DataFrame, groups: Sequence[str], ts: str, share: float = 0.75) -> DataFrame:
    """Earliest share of each group's rows is ``meta_train``; ties go by ``sensor_id``."""
    s = Series(keys=tuple(groups), ts=ts, ties=("sensor_id",))
    sizes = stage(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")))
    return (
        with_ordinal(df, s)
        .join(sizes, list(groups))
        .withColumn(
            "meta_split",
            F.when(F.col("_ord") < F.floor(F.col("_n") * share), "meta_train").otherwise(
                "meta_validation"
            ),
        )
        .drop("_ord", "_n", "_us", "_blk")
    )


def median_impute(
    train: DataFrame, rows: DataFrame, columns: Sequence[str], indicators: bool = False
) -> DataFrame:
    """Fill nulls with medians of the training rows only, optionally with indicators."""
    cells = train.unpivot([], list(columns), "column", "value")
    medians = exact_quantiles(cells, ["column"], "value", {"median": 0.5})
    wide = medians.groupBy().pivot("column", list(columns)).agg(F.max("median"))
    filled = rows.withColumn("_m", single_row(wide))
    extra = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns] if indicators else []
    keep = [c for c in rows.columns if c not in columns]
    return filled.select(
        *keep, *[F.coalesce(F.col(c), F.col("_m")[c]).alias(c) for c in columns], *extra
    )


def standard_scale(
    train: DataFrame, rows: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Centre and scale by the training mean and population deviation."""
    stats = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )
    keep = [c for c in rows.columns if c not in columns]

    def scaled(c: str) -> Column:
        mean, std = F.col("_s")[f"mean_{c}"], F.col("_s")[f"std_{c}"]
        return ((F.col(c) - mean) / F.when(std > 0, std).otherwise(1.0)).alias(c)

    return rows.withColumn("_s", single_row(stats)).select(*keep, *[scaled(c) for c in columns])


@dataclass(frozen=True)
class ForecastModel:
    """A named recipe: an unfitted regressor factory, optionally on changes."""

    name: str
    regressor: Callable[[], object]
    delta: bool = False


def forest(trees: int = 180, depth: int = 14) -> Callable[[], object]:
    return lambda: RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=42, featuresCol="features", labelCol="_label"
    )


def boosted(rounds: int = 320, depth: int = 5, step: float = 0.04) -> Callable[[], object]:
    return lambda: GBTRegressor(
        maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, featuresCol="features",
        labelCol="_label",
    )


def penalised(l1: float, l2: float, label_std: float) -> LinearRegression:
    """Least squares with ``sum(e^2) / 2n + l1 |b| + l2 b^2 / 2``.

    Spark divides the label by its population deviation before it applies the
    penalties, which leaves the first one as it is and weakens the second.
    """
    total = l1 + l2 * label_std
    return LinearRegression(
        regParam=total, elasticNetParam=l1 / total if total else 0.0, standardization=False,
        solver="normal" if l1 == 0 else "auto", featuresCol="features", labelCol="_label",
    )


def ridge(alpha: float, rows: int, label_std: float) -> LinearRegression:
    """Penalty ``alpha b^2`` beside the plain sum of squares."""
    return penalised(0.0, alpha / max(rows, 1), label_std)


def elastic_net(alpha: float, share: float, label_std: float) -> LinearRegression:
    return penalised(alpha * share, alpha * (1 - share), label_std)


def fit_predict(
    train: DataFrame,
    rows: DataFrame,
    model: ForecastModel,
    features: Sequence[str],
    target: str,
    current: str = "pm25",
    out: str = "predicted",
):
    """Fit on rows with a target and predict ``rows``; returns (predictions, fitted model).

    With ``delta`` the model learns the change and adds the current value back.
    """
    imputed = [f"_f_{f}" for f in features]
    label = F.col(target) - F.col(current) if model.delta else F.col(target)

    def doubles(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_i_{f}": F.col(f).cast("double") for f in features})

    pipeline = Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=[f"_i_{f}" for f in features], outputCols=imputed),
            VectorAssembler(inputCols=imputed, outputCol="features"),
            model.regressor(),
        ]
    )
    fitted = pipeline.fit(doubles(train.where(F.col(target).isNotNull())).withColumn("_label", label))
    scored = fitted.transform(doubles(rows)).withColumn(
        out,
        F.col("prediction") + F.col(current) if model.delta else F.col("prediction"),
    )
    drop = [c for c in scored.columns if c.startswith(("_i_", "_f_"))]
    return scored.drop("features", "prediction", *drop), fitted


def feature_importance(fitted, features: Sequence[str], spark) -> DataFrame:
    """Importances of the fitted tree model, one row per feature (bounded by their number)."""
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def oof_predictions(
    df: DataFrame,
    ts: str,
    folds: Sequence[tuple[str, str]],
    model: ForecastModel,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
) -> DataFrame:
    """Fold-wise fit and predict; the loop is over folds, each fit is a Spark job."""
    parts = []
    for i, (start, end) in enumerate(folds, 1):
        a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        train = df.where(F.col(ts) < a)
        rows = df.where((F.col(ts) >= a) & (F.col(ts) < b))
        scored, _ = fit_predict(train, rows, model, features, target)
        parts.append(
            scored.select(
                *keys,
                F.lit(model.name).alias("model"),
                F.lit(i).alias("fold"),
                F.col(target).alias("actual"),
                "predicted",
                (F.col(target) - F.col("predicted")).alias("residual"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fourier_terms(us: Column, order: int = 4) -> list[Column]:
    """Intercept, trend in days, and daily sine and cosine terms."""
    import math

    days = us / 86_400_000_000
    terms = [F.lit(1.0), days]
    for k in range(1, order + 1):
        terms += [F.sin(days * (2 * math.pi * k)), F.cos(days * (2 * math.pi * k))]
    return terms


def seasonal_regression(
    train: DataFrame, rows: DataFrame, s: Series, value: str, order: int = 4, minimum: int = 96,
    ridge_share: float = 1e-9,
) -> DataFrame:
    """Per-key trend plus daily seasonality by least squares.

    The normal equations are grouped sums with map-side combine, so a key's
    length does not matter; only the small systems are solved one per key.
    """
    import numpy as np

    keys = list(s.keys)
    origin = train.agg(F.min(micros(s.ts)).alias("_o"))
    size = 2 + 2 * order

    def design(df: DataFrame) -> DataFrame:
        since = micros(s.ts) - F.col("_o")["_o"]
        return df.withColumn("_o", single_row(origin)).withColumn(
            "_x", F.array(*fourier_terms(since, order))
        )

    used = design(train.where(F.col(value).isNotNull()))
    x = [F.element_at("_x", i + 1) for i in range(size)]
    sums = [F.sum(x[i] * x[j]).alias(f"_a{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(x[i] * F.col(value)).alias(f"_b{i}") for i in range(size)]
    moments = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums).where(
        F.col("_n") >= minimum
    )

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            coefs = []
            for row in pdf.itertuples(index=False):
                values = row._asdict() if hasattr(row, "_asdict") else dict(zip(pdf.columns, row))
                flat = dict(zip(pdf.columns, values.values()))
                a = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        a[i, j] = a[j, i] = flat[f"_a{i}_{j}"]
                b = np.array([flat[f"_b{i}"] for i in range(size)])
                a += np.eye(size) * ridge_share * np.trace(a) / size
                coefs.append(np.linalg.lstsq(a, b, rcond=None)[0].tolist())
            out = pdf[keys].copy()
            out["_beta"] = pd.Series(coefs, index=out.index, dtype=object)
            yield out

    types = {f.name: f.dataType.simpleString() for f in train.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _beta array<double>"
    betas = moments.mapInPandas(solve, schema)
    fitted = F.aggregate(
        F.zip_with("_x", "_beta", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q
    )
    return design(rows).join(betas, keys, "left").withColumn("predicted", fitted).drop(
        "_x", "_beta", "_o"
    )


def pca(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Principal components of standardised complete rows, per group.

    Every task reduces its rows to one count, mean and product matrix per group; the
    correlation matrix comes from their sums, and its eigenvectors are taken for each
    group's small matrix.  Signs make each largest loading positive.  Constant columns, which have no
    correlation, take no share.
    """
    import numpy as np
    import pandas as pd

    columns = list(columns)
    k = len(columns)
    keyed = df if group else df.withColumn("_g", F.lit("all"))
    key = group or "_g"
    kind = dict(keyed.dtypes)[key]
    complete = keyed.na.drop(subset=columns).select(key, *columns)

    def merged(a, b):
        """Moments of both parts, centred at their common mean."""
        if a is None:
            return b
        n, step = a[0] + b[0], b[1] - a[1]
        return (
            n,
            a[1] + step * (b[0] / n),
            a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n),
        )

    def reduced(batches):
        parts = {}
        for pdf in batches:
            for g, rows in pdf.groupby(key, dropna=False):
                x = rows[columns].to_numpy(float)
                mean = x.mean(0)
                g = None if pd.isna(g) else g
                parts[g] = merged(parts.get(g), (len(x), mean, (x - mean).T @ (x - mean)))
        yield pd.DataFrame(
            [(g, n, mean, product.ravel()) for g, (n, mean, product) in parts.items()],
            columns=[key, "n", "mean", "product"],
        )

    def decompose(pdf):
        total = None
        for n, mean, product in zip(pdf["n"], pdf["mean"], pdf["product"]):
            total = merged(total, (int(n), np.array(mean), np.array(product).reshape(k, k)))
        n, mean, product = total
        scale = np.sqrt(np.diag(product))
        # A constant column has no share in any component.
        varies = scale > 1e-12 * np.abs(mean) * np.sqrt(n)
        m = product / np.outer(*[np.where(varies, scale, 1.0)] * 2) * np.outer(varies, varies)
        np.fill_diagonal(m, varies.astype(float))
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(values)[::-1]
        values, vectors = np.clip(values[order], 0, None), vectors[:, order]
        shares = values / max(values.sum(), 1.0)
        sums = np.cumsum(shares)
        out = []
        for c in range(k):
            v = vectors[:, c]
            v = v if v[np.argmax(np.abs(v))] > 0 else -v
            for i, name in enumerate(columns):
                out.append(
                    (pdf[key].iloc[0], n, c + 1, float(shares[c]), float(sums[c]), name, float(v[i]))
                )
        return pd.DataFrame(
            out,
            columns=[key, "n", "component", "explained_ratio", "cumulative_ratio", "channel",
                     "loading"],
        )

    moments = complete.mapInPandas(
        reduced, f"{key} {kind}, n long, mean array<double>, product array<double>"
    )
    return moments.groupBy(key).applyInPandas(
        decompose,
        f"{key} {kind}, n long, component int, explained_ratio double, cumulative_ratio double, "
        "channel string, loading double",
    )


def pca_by_presence(
    df: DataFrame, columns: Sequence[str], group: str, present: float = 0.95, minimum: int = 100
) -> DataFrame:
    """``pca`` of each group over the columns that hold a value in a share ``present`` of its rows.

    Groups with fewer than two such columns or ``minimum`` complete rows have no components.  Groups
    of equal columns are decomposed together; there are at most 2 ** columns kinds of groups.
    """
    held = [F.avg(finite(F.col(c)).isNotNull().cast("int")) for c in columns]
    chosen = F.array_compact(F.array(*[F.when(h >= present, F.lit(c)) for h, c in zip(held, columns)]))
    kinds = stage(df.groupBy(group).agg(chosen.alias("_columns")))
    clean = df.select(group, *[finite(F.col(c)).alias(c) for c in columns])
    out = clean.sparkSession.createDataFrame(
        [], f"{group} {dict(df.dtypes)[group]}, n long, component int, explained_ratio double, "
        "cumulative_ratio double, channel string, loading double",
    )
    for (own,) in kinds.select("_columns").where(F.size("_columns") >= 2).distinct().collect():
        alike = kinds.where(F.col("_columns") == F.array(*map(F.lit, own))).select(group)
        out = out.unionByName(pca(clean.join(alike, group, "left_semi"), own, group))
    return out.where(F.col("n") >= minimum)


def pca_summary(
    components: DataFrame, group: str, thresholds: Sequence[float] = (0.8, 0.9, 0.95), dominant: int = 2, first: int = 3
) -> DataFrame:
    """Per group: how many components explain each threshold, and the channels that dominate the first ones.

    ``components`` comes from ``pca``; a group has at most columns ** 2 rows there.
    """
    needed = [
        F.min(F.when(F.col("cumulative_ratio") >= t, F.col("component"))).alias(f"components_{round(100 * t)}")
        for t in thresholds
    ]
    place = F.row_number().over(Window.partitionBy(group, "component").orderBy(F.abs("loading").desc(), "channel"))
    ranked = components.withColumn("_rank", place)
    names = F.array_sort(F.collect_list(F.when(F.col("_rank") <= dominant, F.struct("_rank", "channel"))))
    leading = (
        ranked.where(F.col("component") <= first)
        .groupBy(group, "component")
        .agg(F.array_join(F.transform(names, lambda x: x["channel"]), " and ").alias("_text"))
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("component", "_text"))).alias("_all"))
        .select(group, F.array_join(F.transform("_all", lambda x: F.concat(F.lit("PC"), x["component"].cast("string"), F.lit(": "), x["_text"])), "; ").alias("dominant"))
    )
    sizes = components.groupBy(group).agg(F.max("n").alias("n"), F.count_distinct("channel").alias("channels"), *needed)
    return sizes.join(leading, group)


def kmeans_select(df: DataFrame, vector: str, ks: Sequence[int] = range(2, 7)):
    """Fit each k; returns (evaluation rows, model with the best silhouette)."""
    rows, best = [], None
    for k in ks:
        model = KMeans(k=k, seed=42, featuresCol=vector, predictionCol="cluster").fit(df)
        score = ClusteringEvaluator(featuresCol=vector, predictionCol="cluster").evaluate(
            model.transform(df)
        )
        rows.append((k, float(model.summary.trainingCost), float(score)))
        if best is None or score > best[0]:
            best = (score, model)
    table = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    return table, best[1]


def cluster_profiles(
    df: DataFrame, channels: Sequence[str], cluster: str = "cluster", top: int = 2
) -> DataFrame:
    """Per cluster: share, channel means and the most distinguishing channels."""
    long = df.unpivot([cluster], list(channels), "channel", "value")
    overall = long.groupBy("channel").agg(
        F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")
    )
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    stats = long.groupBy(cluster, "channel").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    scored = (
        stats.join(F.broadcast(overall), "channel")
        .withColumn("_n", single_row(total)["_n"])
        .withColumn(
            "standardized",
            (F.col("mean") - F.col("_m"))
            / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0),
        )
        .withColumn("share", 100 * F.col("count") / F.col("_n"))
    )
    rank = F.row_number().over(
        Window.partitionBy(cluster).orderBy(F.abs("standardized").desc(), "channel")
    )
    return scored.withColumn("distinguishing", rank <= top).drop("_m", "_s", "_n")


def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))
