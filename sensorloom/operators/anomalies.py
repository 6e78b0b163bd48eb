"""Anomaly detectors, their consensus, regime changes and decomposition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import exact_quantiles, robust_scale
from sensorloom.operators.moving import rolling_deviation
from sensorloom.operators.quality import MAD_NORMAL, MAD_ROUNDED
from sensorloom.operators.relations import complete_runs, longest_run, short_gap_interpolate
from sensorloom.operators.series import (
    MINUTE, Series, bucket_index, frame_window, home_rows, micros, time_halo, with_ordinal,
)
from sensorloom.operators.serving import top_per_group
from sensorloom.sources.staging import stage

METHODS = ["zscore", "mad", "iqr", "rolling_zscore", "isolation_forest", "lof"]


def rolling_robust_z(long: DataFrame, s: Series, rows: int = 96, minimum: int = 24) -> DataFrame:
    """Distance to the rolling median in rolling MADs, over the last ``rows`` rows."""
    return rolling_deviation(long, s.by("channel"), rows, minimum, MAD_ROUNDED, "rolling_z")


def anomaly_univariate(
    long: DataFrame, s: Series, rows: int = 96, minimum: int = 24, least_values: int = 30
) -> DataFrame:
    """Flags of the four univariate methods for every present value."""
    keys = [*s.keys, "channel"]
    moments = long.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"),
        F.count("value").alias("_n"),
    )
    scale = robust_scale(long, keys, "value", MAD_NORMAL)
    stats = stage(moments.where(F.col("_n") >= least_values).join(scale, keys))
    value = F.col("value")
    joined = rolling_robust_z(long, s, rows, minimum).join(stats, keys)
    flags = {
        "zscore_flag": (F.col("_std") > 0) & (F.abs(value - F.col("_mean")) / F.col("_std") > 4),
        "mad_flag": (F.col("mad") > 0) & (F.abs(value - F.col("median")) / F.col("mad") > 4.5),
        "iqr_flag": (value < F.col("q1") - 3 * F.col("iqr"))
        | (value > F.col("q3") + 3 * F.col("iqr")),
        "rolling_zscore_flag": F.col("rolling_z") > 5,
    }
    return joined.select(
        *long.columns, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]
    ).where(value.isNotNull())


def anomaly_candidates(flagged: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Rows any method flags, with the methods' count and names."""
    present = [m for m in methods if f"{m}_flag" in flagged.columns]
    names = F.array_compact(F.array(*[F.when(F.col(f"{m}_flag"), F.lit(m)) for m in present]))
    return (
        flagged.withColumn("_m", names)
        .where(F.size("_m") > 0)
        .withColumn("methods_triggered", F.size("_m"))
        .withColumn("methods", F.array_join("_m", ","))
        .drop("_m")
    )


def near_event_join(
    df: DataFrame, events: DataFrame, keys: Sequence[str], ts: str, event_ts: str, hours: int = 6
) -> DataFrame:
    """Rows within ``hours`` of an event of the same keys, each once.

    Events are copied into the three time buckets they can reach, so the band
    condition becomes an equi join on the bucket.
    """
    size = hours * 60 * MINUTE
    reach = events.select(
        *keys,
        micros(event_ts).alias("_e"),
        F.explode(
            F.sequence(
                bucket_index(micros(event_ts), size) - 1, bucket_index(micros(event_ts), size) + 1
            )
        ).alias("_bucket"),
    )
    # Read for the stamps and for the rows they select.
    rows = stage(df.withColumn("_us", micros(ts)).withColumn("_bucket", bucket_index(F.col("_us"), size)))
    stamps = rows.select(*keys, "_bucket", "_us").distinct()
    hits = (
        stamps.join(reach, [*keys, "_bucket"])
        .where(F.abs(F.col("_us") - F.col("_e")) <= size)
        .select(*keys, "_us")
        .distinct()
    )
    return rows.join(hits, [*keys, "_us"], "left_semi").select(*df.columns)


def anomaly_consensus(
    candidates: DataFrame,
    s: Series,
    changes: DataFrame | None = None,
    isolation_minutes: int = 30,
) -> DataFrame:
    """Category of each candidate; later rules override earlier ones."""
    keys = [*s.keys, "channel"]
    key = s.keys[0]
    candidates = stage(candidates)
    spans = candidates.withColumn("_us", micros(s.ts)).groupBy(*keys).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last")
    )
    by = s.by("channel")
    spread = time_halo(candidates.join(spans, keys), by, isolation_minutes, isolation_minutes)
    near = isolation_minutes * MINUTE
    w = frame_window(by).rangeBetween(-near, near)
    alone = (
        (F.count(F.lit(1)).over(w) == 1)
        & (F.col("_us") > F.col("_first"))
        & (F.col("_us") < F.col("_last"))
    )
    rows = home_rows(spread.withColumn("_alone", alone)).drop("_first", "_last", "_us")
    channels = candidates.groupBy(key, s.ts).agg(F.count_distinct("channel").alias("_channels"))
    shared = candidates.groupBy("city", s.ts, "channel").agg(F.count_distinct(key).alias("_sensors"))
    rows = rows.join(channels, [key, s.ts]).join(shared, ["city", s.ts, "channel"])
    strong = F.col("methods_triggered") >= 2
    if changes is None:
        rows = rows.withColumn("_shift", F.lit(False))
    else:
        hits = near_event_join(
            candidates, changes.select(*keys, "change_timestamp"), keys, s.ts, "change_timestamp"
        ).select(*keys, s.ts).distinct().withColumn("_shift", F.lit(True))
        rows = rows.join(hits, [*keys, s.ts], "left").na.fill(False, ["_shift"])
    category = (
        F.when(F.col("_shift") & strong, "PERSISTENT_SHIFT")
        .when(F.col("_sensors") >= 2, "LIKELY_ENVIRONMENTAL_EVENT")
        .when(strong & F.col("_alone"), "ISOLATED_SPIKE")
        .when(F.col("_channels") >= 2, "MULTIVARIATE_ANOMALY")
        .otherwise("UNCERTAIN")
    )
    return rows.withColumn("category", category).drop("_alone", "_channels", "_sensors", "_shift")


def change_points(
    long: DataFrame,
    s: Series,
    window_rows: int = 96,
    least_days: int = 5,
    penalty: float = 8.0,
) -> DataFrame:
    """Regime changes inside complete runs.

    Each bucket compares the day before with the day after it.  A change is a
    local maximum of the standardised difference, one day apart from better
    ones, whose squared-error gain exceeds ``penalty * ln(run length)``.  ``rank``
    orders the changes of a run, the largest first.
    """
    by = s.by("channel")
    keys = [*by.keys, "run"]
    step = s.cadence_minutes * MINUTE
    day = window_rows * step
    filled = short_gap_interpolate(long, s)
    runs = stage(complete_runs(filled, s).drop("_us"))
    scale = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_sd")
    )
    usable = stage(scale.where((F.col("_n") >= least_days * window_rows) & (F.col("_sd") > 0)))
    long_runs = runs.join(usable, keys)
    minutes = window_rows * s.cadence_minutes
    spread = time_halo(long_runs, by, minutes, minutes)
    w = frame_window(by, "run")
    before, after = w.rangeBetween(-day, -step), w.rangeBetween(0, day - step)
    half = window_rows // 2
    stats = home_rows(
        spread.select(
            "*",
            F.avg("value").over(before).alias("_m0"),
            F.avg("value").over(after).alias("_m1"),
            F.var_pop("value").over(before).alias("_v0"),
            F.var_pop("value").over(after).alias("_v1"),
            F.count(F.lit(1)).over(before).alias("_n0"),
            F.count(F.lit(1)).over(after).alias("_n1"),
        )
    )
    mean_part = F.abs(F.col("_m1") - F.col("_m0")) / F.col("_sd")
    variance = F.greatest(F.col("_sd") * F.col("_sd"), F.lit(1e-9))
    variance_part = F.abs(F.col("_v1") - F.col("_v0")) / variance
    scored = stats.where((F.col("_n0") >= half) & (F.col("_n1") >= half)).withColumns(
        # Nine places, so that equal scores stay equal however they were summed.
        {"_mp": F.round(mean_part, 9), "_vp": F.round(variance_part, 9)}
    ).withColumn("_score", F.greatest("_mp", "_vp"))
    spread = time_halo(scored.drop("_us"), by, minutes, minutes)
    peak = F.max("_score").over(w.rangeBetween(-day, day))
    earlier = F.max("_score").over(w.rangeBetween(-day, -step))
    best = home_rows(spread.withColumns({"_peak": peak, "_earlier": earlier})).where(
        (F.col("_score") == F.col("_peak"))
        & (F.col("_earlier").isNull() | (F.col("_earlier") < F.col("_score")))
        & (window_rows * F.col("_score") * F.col("_score") / 2 >= penalty * F.log("_n"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_us"))
    shift = F.col("_mp") >= F.col("_vp")
    return best.withColumn("rank", rank).select(
        *by.keys,
        F.col(s.ts).alias("change_timestamp"),
        F.when(shift, "MEAN_SHIFT").otherwise("VARIANCE_SHIFT").alias("change_type"),
        F.when(shift, F.col("_m0")).otherwise(F.col("_v0")).alias("before_statistic"),
        F.when(shift, F.col("_m1")).otherwise(F.col("_v1")).alias("after_statistic"),
        F.when(shift, F.col("_m1") - F.col("_m0")).otherwise(F.col("_v1") - F.col("_v0")).alias(
            "magnitude"
        ),
        F.col("_mp").alias("standardized_magnitude"),
        "rank",
    )


def seasonal_components(
    long: DataFrame,
    s: Series,
    period: int = 96,
    least_periods: int = 7,
    most_missing: float = 0.08,
) -> DataFrame:
    """Additive daily components of each series' longest complete run.

    Series whose grid misses more than ``most_missing`` of its buckets, or whose
    run is shorter than ``least_periods`` days, are left out.
    """
    by = s.by("channel")
    keys = list(by.keys)
    step = s.cadence_minutes * MINUTE
    span = long.withColumn("_us", micros(s.ts)).groupBy(*s.keys).agg(
        ((F.max("_us") - F.min("_us")) / step + 1).alias("_grid")
    )
    rates = stage(
        long.groupBy(*keys)
        .agg(F.count("value").alias("_present"))
        .join(span, list(s.keys))
        .where((1 - F.col("_present") / F.col("_grid") <= most_missing)
               & (F.col("_grid") >= least_periods * period))
        .select(*keys)
    )
    kept = long.join(rates, keys, "left_semi")
    runs = longest_run(short_gap_interpolate(kept, s, both=True), s).where(
        F.col("run_length") >= least_periods * period
    )
    half = period // 2
    minutes = half * s.cadence_minutes
    spread = time_halo(runs.drop("_us"), by, minutes, minutes)
    w = frame_window(by).rangeBetween(-half * step, half * step)
    trended = home_rows(
        spread.withColumn(
            "trend",
            F.when(F.count(F.lit(1)).over(w) == 2 * half + 1, F.avg("value").over(w)),
        )
    ).where(F.col("trend").isNotNull())
    phase = F.pmod(bucket_index(F.col("_us"), step), F.lit(period))
    detrended = trended.withColumn("_phase", phase).withColumn(
        "_d", F.col("value") - F.col("trend")
    )
    phases = detrended.groupBy(*keys, "_phase").agg(F.avg("_d").alias("_p"))
    # At most ``period`` rows per series.
    centred = phases.withColumn("seasonal", F.col("_p") - F.avg("_p").over(Window.partitionBy(*keys)))
    return (
        detrended.join(centred.drop("_p"), [*keys, "_phase"])
        .withColumn("residual", F.col("_d") - F.col("seasonal"))
        .select(*keys, s.ts, F.col("value").alias("observed"), "trend", "seasonal", "residual")
    )


def seasonal_strength(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How much of the variance the seasonal and the trend component explain."""

    def strength(part: str) -> Column:
        whole = F.var_pop(F.col("residual") + F.col(part))
        return F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("residual"), whole))

    return components.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        strength("seasonal").alias("seasonal_strength"),
        strength("trend").alias("trend_strength"),
    )


def _average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow_tree(points, rng, limit: int) -> list[tuple]:
    """One random split tree: a row (feature, cut, left, right, path length) per node.

    Nodes hold few rows, for which plain lists are faster than arrays.  A leaf leads to itself, and
    its path length is its depth and what is expected for the rows it was not split into.
    """
    nodes: list[tuple] = []

    def grow(rows: list, depth: int) -> int:
        index = len(nodes)
        nodes.append((0, 0.0, index, index, depth + _average_path(len(rows))))
        if depth >= limit or len(rows) <= 1:
            return index
        ranges = [(min(c), max(c)) for c in zip(*rows)]
        usable = [i for i, (low, high) in enumerate(ranges) if high > low]
        if not usable:
            return index
        feature = usable[int(rng.integers(len(usable)))]
        cut = rng.uniform(*ranges[feature])
        below = [r for r in rows if r[feature] < cut]
        if not below or len(below) == len(rows):
            return index
        left = grow(below, depth + 1)
        right = grow([r for r in rows if not r[feature] < cut], depth + 1)
        nodes[index] = (feature, cut, left, right, 0.0)
        return index

    grow(points.tolist(), 0)
    return nodes


def _path_lengths(table, points, limit: int):
    """Path lengths of the points in a tree, given as the array of its nodes."""
    import numpy as np

    feature, left, right = (table[:, i].astype(np.int64) for i in (0, 2, 3))
    cells, first = points.ravel(), np.arange(len(points)) * points.shape[1]
    at = np.zeros(len(points), np.int64)
    for _ in range(limit):
        at = np.where(cells[first + feature[at]] < table[at, 1], left[at], right[at])
    return table[at, 4]


def isolation_forest(
    df: DataFrame,
    s: Series,
    channels: Sequence[str],
    trees: int = 200,
    sample: int = 256,
    contamination: float = 0.015,
    minimum: int = 100,
    rows_per_task: int = 50_000,
) -> DataFrame:
    """Isolation score per complete row and a flag for the most isolated share.

    A key is judged on the channels it provides, those with any value; a row is complete
    if it has all of them, and rows that lack one have no score.

    Each tree has a sample of its own, drawn by hash from all rows of its key: the
    ``trees * sample`` rows with the smallest hashes, cut into one part per tree;
    where a key has fewer rows, each tree draws from all of them.  Rows are scored
    in parts of bounded size that each receive a copy of their key's trees, so a
    hot key is scored by many tasks; the threshold is an exact quantile.
    """
    import numpy as np
    import pandas as pd

    keys, channels = list(s.keys), list(channels)
    given = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in channels}
    provided = df.groupBy(*keys).agg(*[F.max(given[c]).alias(f"_has_{c}") for c in channels])
    whole = F.forall(
        F.array(*[given[c] | ~F.col(f"_has_{c}") for c in channels]), lambda x: x
    ) & F.exists(F.array(*[F.col(f"_has_{c}") for c in channels]), lambda x: x)
    complete = df.join(provided, keys).where(whole).select(*keys, s.ts, *channels)
    sizes = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    complete = complete.join(sizes.where(F.col("_size") >= minimum).select(*keys), keys, "left_semi")
    order = F.xxhash64(F.col(s.ts).cast("string"), *channels)
    picked = top_per_group(
        complete.withColumn("_o", order), keys, trees * sample, F.col("_o"), F.col(s.ts)
    ).withColumnRenamed("rank", "_rn")
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(42)
        pdf = pdf.sort_values("_rn")
        used = [c for c in channels if pdf[c].notna().all()]
        points = pdf[used].to_numpy(float)
        size = min(sample, len(points))
        limit = math.ceil(math.log2(max(size, 2)))
        enough = len(points) >= trees * sample
        grown = [
            _grow_tree(
                points[i * size : (i + 1) * size]
                if enough
                else points[rng.choice(len(points), size, replace=False)],
                rng,
                limit,
            )
            for i in range(trees)
        ]
        out = pdf[keys].head(1).copy()
        out["size"], out["channels"], out["nodes"] = size, [used], [[len(t) for t in grown]]
        out["forest"] = np.concatenate([np.array(t, float) for t in grown]).tobytes()
        return out

    model_schema = "size int, channels array<string>, nodes array<int>, forest binary"
    # Trees cost far more than the bytes of their rows suggest, so partitions are given by number;
    # staged, or the planner would keep the partitions of the ranking, which are merged by size.
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forests = stage(picked).repartition(count, *keys).groupBy(*keys).applyInPandas(grow, f"{key_schema}, {model_schema}")
    numbered = with_ordinal(complete, s).withColumn(
        "_part", F.floor(F.col("_ord") / rows_per_task)
    ).drop("_us", "_blk", "_ord")
    parts = numbered.select(*keys, "_part").distinct()
    copies = parts.join(forests, keys).select(
        *[F.col(k).alias(f"_copy_{k}") for k in [*keys, "_part"]], "size", "channels", "nodes", "forest"
    )
    copy_keys = [f"_copy_{k}" for k in [*keys, "_part"]]
    numbered, copies = numbered.repartition(count, *keys, "_part"), copies.repartition(count, *copy_keys)

    def score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        model = forest.iloc[0]
        points = np.ascontiguousarray(rows[list(model["channels"])].to_numpy(float))
        tables = np.split(np.frombuffer(model["forest"]).reshape(-1, 5), np.cumsum(model["nodes"])[:-1])
        limit = math.ceil(math.log2(max(model["size"], 2)))
        depth = np.mean([_path_lengths(t, points, limit) for t in tables], axis=0)
        out = rows[[*keys, s.ts]].copy()
        out["isolation_score"] = 2.0 ** (-depth / max(_average_path(model["size"]), 1e-12))
        return out

    scored = numbered.groupBy(*keys, "_part").cogroup(copies.groupBy(*copy_keys)).applyInPandas(
        score, f"{key_schema}, {s.ts} {types[s.ts]}, isolation_score double"
    )
    scored = stage(scored)
    limits = exact_quantiles(scored, keys, "isolation_score", {"_limit": 1 - contamination})
    return scored.join(limits, keys).select(
        *keys,
        s.ts,
        "isolation_score",
        (F.col("isolation_score") > F.col("_limit")).alias("isolation_forest_flag"),
    )
