"""Distribution, profile and density statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import (
    exact_quantiles, finite, order_bin, value_ranks, with_parts,
)
from sensorloom.functions.sums import steady_mean
from sensorloom.operators.moving import moving_statistics
from sensorloom.operators.series import Series, with_ordinal
from sensorloom.sources.staging import stage

# The probabilities of the descriptive table.
PERCENTILES = {
    "p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50,
    "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99,
}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; 0 below three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 below four values."""
    n = F.count(value).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, corrected).otherwise(0.0)


def with_scopes(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Repeat each row once per scope, adding ``scope_type`` and ``scope_value``."""
    options = [
        F.struct(F.lit(kind).alias("scope_type"), value.cast("string").alias("scope_value"))
        for kind, value in scopes.items()
    ]
    return df.withColumn("_scope", F.explode(F.array(*options))).select(
        "*", "_scope.scope_type", "_scope.scope_value"
    ).drop("_scope")


def standard_scopes(sensor: str = "sensor_id") -> dict[str, Column]:
    return {"global": F.lit("All sensors"), "city": F.col("city"), "sensor": F.col(sensor)}


def descriptive_stats(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments, quantiles, shape and spread per group of finite values."""
    keys = list(keys)
    good = long.select(*keys, finite(F.col("value")).alias("value")).where("value IS NOT NULL")
    value = F.col("value")
    moments = good.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("variance"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        sample_skewness(value).alias("skewness"),
        sample_kurtosis(value).alias("kurtosis"),
    )
    quantiles = exact_quantiles(good, keys, "value", PERCENTILES)
    return moments.join(quantiles, keys).withColumn(
        "iqr", F.col("p75") - F.col("p25")
    ).withColumn(
        "coefficient_of_variation",
        F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")),
    )


def trait_text() -> Column:
    """Readable traits of a row of ``descriptive_stats`` joined with ``modes``."""
    skew, side = F.col("skewness"), F.when(F.col("skewness") > 0, "right").otherwise("left")
    low = F.col("std") <= F.greatest(F.abs("mean") * 0.01, F.lit(1e-9))
    traits = F.array_compact(
        F.array(
            F.when(F.abs(skew) >= 1, F.format_string("strongly %s-skewed", side)).when(
                F.abs(skew) >= 0.5, F.format_string("moderately %s-skewed", side)
            ),
            F.when(F.col("kurtosis") >= 3, F.lit("heavy-tailed")),
            F.when(
                F.col("modes") >= 2,
                F.format_string("possibly multimodal (%d density peaks)", "modes"),
            ),
            F.when(low, F.lit("low-variance")),
        )
    )
    joined = F.array_join(traits, ", ")
    return F.format_string(
        "%s is %s; P95=%.2f, P99=%.2f.",
        F.upper("channel"),
        F.when(F.size(traits) > 0, joined).otherwise("no strong skew or tail signal"),
        F.col("p95"),
        F.col("p99"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, least_bins: int = 10) -> DataFrame:
    """Equal-width histogram per group; ``min(40, max(least_bins, int(sqrt n)))`` bins, last one closed."""
    keys = list(keys)
    good = df.select(*keys, finite(F.col(value)).alias("_v")).where("_v IS NOT NULL")
    span = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    flat = F.col("_lo") == F.col("_hi")
    span = stage(span.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
        F.least(
            F.lit(40), F.greatest(F.lit(least_bins), F.floor(F.sqrt("_n")).cast("int"))
        ).alias("bins"),
    ))
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    placed = good.join(span, keys)
    index = F.least(
        F.floor((F.col("_v") - F.col("_lo")) * F.col("bins") / (F.col("_hi") - F.col("_lo"))),
        F.col("bins") - 1,
    ).cast("int")
    counts = placed.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    empty = span.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
        "bins",
        (F.col("_lo")).alias("_lo"),
        width.alias("_w"),
    )
    return empty.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
        F.coalesce("_c", F.lit(0)).alias("count"),
    )


SMOOTHING_SIGMA = 1.2
SMOOTHING_RADIUS = 5


def smoothing_weights() -> list[float]:
    raw = [
        math.exp(-0.5 * (k / SMOOTHING_SIGMA) ** 2)
        for k in range(-SMOOTHING_RADIUS, SMOOTHING_RADIUS + 1)
    ]
    return [w / sum(raw) for w in raw]


def mode_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of prominent peaks of the smoothed histogram of each group.

    The rows are reduced to at most 40 bins per group; the peak search then works
    on that short array.
    """
    keys = list(keys)
    bins = histogram(df, keys, value, least_bins=12)
    arrays = bins.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin", "count"))),
            lambda x: x["count"].cast("double"),
        ).alias("_c"),
        F.sum("count").alias("_n"),
    )
    n = F.size("_c")

    def mirrored(i: Column) -> Column:
        return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)

    def smooth_at(i: Column) -> Column:
        return sum(
            (
                F.element_at("_c", (mirrored(i + k) + 1).cast("int")) * w
                for k, w in zip(range(-SMOOTHING_RADIUS, SMOOTHING_RADIUS + 1), smoothing_weights())
            ),
            F.lit(0.0),
        )

    positions = F.sequence(F.lit(0), n - 1)
    smooth = arrays.withColumn("_s", F.transform(positions, smooth_at)).withColumn(
        "_need", F.greatest(F.lit(1.0), F.array_max("_s") * 0.08)
    )
    s = F.col("_s")

    def at(i: Column) -> Column:
        return F.element_at(s, (i + 1).cast("int"))

    def base(i: Column, side: Column) -> Column:
        """Lowest value between the peak and the nearest higher bin on one side."""
        start = F.struct(F.lit(True).alias("open"), at(i).alias("low"))

        def step(acc: Column, j: Column) -> Column:
            still = acc["open"] & (at(j) <= at(i))
            return F.struct(
                still.alias("open"),
                F.when(still, F.least(acc["low"], at(j))).otherwise(acc["low"]).alias("low"),
            )

        return F.aggregate(side, start, step, lambda acc: acc["low"])

    def is_peak(i: Column) -> Column:
        left = F.reverse(F.sequence(F.lit(0), i))
        right = F.sequence(i, n - 1)
        prominence = at(i) - F.greatest(base(i, left), base(i, right))
        return (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & (prominence >= F.col("_need"))

    inner = F.sequence(F.lit(1), n - 2)
    peaks = F.size(F.filter(inner, is_peak))
    distinct = (
        df.where(F.col(value).isNotNull())
        .select(*keys, value)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_d"))
    )
    return smooth.join(distinct, keys).select(
        *keys,
        F.when((F.col("_n") < 40) | (F.col("_d") < 5), F.lit(1))
        .otherwise(F.greatest(F.lit(1), peaks))
        .cast("int")
        .alias("modes"),
    )


def calendar_periods(ts: str) -> Column:
    """The hour, weekday, day type, date and week a timestamp falls into."""
    t = F.col(ts)
    day = F.weekday(t)
    monday = F.date_trunc("week", t).cast("date")
    names = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), day + 1)
    kinds = {
        "hour": F.hour(t).cast("string"),
        "day_of_week": names,
        "day_type": F.when(day >= 5, "Weekend").otherwise("Weekday"),
        "daily": F.date_format(t, "yyyy-MM-dd"),
        "weekly": F.concat_ws(
            "/", monday.cast("string"), F.date_add(monday, 6).cast("string")
        ),
    }
    return F.array(
        *[
            F.struct(F.lit(k).alias("pattern_type"), v.alias("period"))
            for k, v in kinds.items()
        ]
    )


def temporal_profile(long: DataFrame, s: Series) -> DataFrame:
    """Statistics by hour, weekday, day type, date and week, per key and channel."""
    by = [*s.keys, "channel", "pattern_type", "period"]
    rows = (
        long.where(F.col("value").isNotNull())
        .withColumn("_p", F.explode(calendar_periods(s.ts)))
        .select(*s.keys, "channel", "_p.pattern_type", "_p.period", "value")
    )
    basic = rows.groupBy(*by).agg(
        # An infinite value has no exact parts.
        F.when(F.max(F.abs("value")) < float("inf"), steady_mean(F.col("value")))
        .otherwise(F.avg("value")).alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    return basic.join(exact_quantiles(rows, by, "value", {"median": 0.5}), by)


def peak_hours(long: DataFrame, s: Series) -> DataFrame:
    """Hour with the highest and the lowest mean, per key and channel (earliest on ties)."""
    hourly = (
        long.where(F.col("value").isNotNull())
        .groupBy(*s.keys, "channel", F.hour(s.ts).alias("_h"))
        .agg(F.avg("value").alias("_m"))
    )
    return hourly.groupBy(*s.keys, "channel").agg(
        F.max_by("_h", F.struct(F.col("_m"), -F.col("_h"))).alias("peak_hour"),
        F.max("_m").alias("peak_mean"),
        F.min_by("_h", F.struct("_m", "_h")).alias("low_hour"),
        F.min("_m").alias("low_mean"),
    )


def rolling_summary(
    long: DataFrame, s: Series, windows_hours: Sequence[int] = (1, 3, 6, 12, 24)
) -> DataFrame:
    """Per key, channel and window: latest and typical rolling statistics.

    Windows run over the present values and need at least two of them.
    """
    by = s.by("channel")
    present = long.where(F.col("value").isNotNull())
    stats = ["mean", "median", "std", "var", "min", "max", "count"]
    wanted = {f"_{stat}_{h}": ("value", h * 60, stat) for h in windows_hours for stat in stats}

    def row(hours: int) -> Column:
        enough = F.col(f"_count_{hours}") >= 2
        parts = [F.when(enough, F.col(f"_{stat}_{hours}")).alias(stat) for stat in stats[:-1]]
        return F.struct(F.lit(hours).alias("window_hours"), *parts)

    # Read by the aggregate and by two passes per quantile; unstaged, each would move the windows again.
    wide = stage(moving_statistics(present, by, wanted).select(*by.keys, "_us", *wanted))
    rows = wide.select(*by.keys, "_us", F.explode(F.array(*map(row, windows_hours))).alias("_r")).select(
        *by.keys, "_us", "_r.*", (F.col("_r.max") - F.col("_r.min")).alias("range")
    )
    keys = [*by.keys, "window_hours"]
    basic = rows.groupBy(*keys).agg(
        F.max_by("mean", "_us").alias("mean_latest"),
        F.max_by("median", "_us").alias("median_latest"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    spread_stats = (
        exact_quantiles(rows, keys, "std", {"std_median": 0.5})
        .join(exact_quantiles(rows, keys, "var", {"variance_median": 0.5}), keys)
        .join(exact_quantiles(rows, keys, "range", {"range_p95": 0.95}), keys)
    )
    return basic.join(spread_stats, keys, "left")


def ecdf(df: DataFrame, keys: Sequence[str], value: str, points: int = 800) -> DataFrame:
    """Empirical distribution on every k-th sorted value."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value)
    step = F.greatest(F.lit(1), F.floor(F.col("group_size") / points))
    first = F.ceil((F.col("rank_last") - F.col("value_count")) / step)
    last = F.floor((F.col("rank_last") - 1) / step)
    sampled = F.floor((F.col("group_size") - 1) / step) + 1
    hits = ranks.where(last >= first)
    return hits.select(
        *keys,
        F.col(value).alias("x"),
        F.explode(F.sequence(first, last)).alias("_i"),
        sampled.alias("_m"),
    ).select(*keys, "x", ((F.col("_i") + 1) / F.col("_m")).alias("y"))


def kde(df: DataFrame, keys: Sequence[str], value: str, points: int = 120) -> DataFrame:
    """Gaussian density on a grid from the 0.5 % to the 99.5 % quantile, Scott bandwidth.

    Distinct values are weighted by their count, and each one adds to all grid
    sums in a single map-side-combined aggregate; nothing is multiplied out.
    """
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")
    )
    ends = exact_quantiles(df, keys, value, {"_a": 0.005, "_b": 0.995})
    weights = stage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    distinct = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    usable = stage(
        moments.join(ends, keys)
        .join(distinct, keys)
        .where((F.col("_n") >= 20) & (F.col("_d") > 2))
        .withColumn("_h", F.col("_sd") * F.pow("_n", F.lit(-0.2)))
    )

    # Written as text: hundreds of sums are slow to build call by call.  They are
    # spread over a few aggregates of moderate width.
    def grid(i: int) -> str:
        return f"(_a + (_b - _a) * {i / (points - 1)!r}D)"

    def kernel(i: int) -> str:
        return f"sum(_c * exp(-0.5D * power(({grid(i)} - `{value}`) / _h, 2)))"

    rows = weights.join(usable, keys)
    scale = f"(_n * _h * {math.sqrt(2 * math.pi)!r}D)"
    out = None
    for start in range(0, points, 30):
        part = range(start, min(start + 30, points))
        sums = rows.groupBy(*keys, "_n", "_h", "_a", "_b").agg(
            *[F.expr(kernel(i)).alias(f"_s{i}") for i in part]
        )
        cells = ", ".join(
            f"named_struct('point', {i}, 'x', {grid(i)}, 'density', _s{i} / {scale})" for i in part
        )
        chunk = sums.select(*keys, F.expr(f"explode(array({cells}))").alias("_g"))
        chunk = chunk.select(*keys, "_g.*")
        out = chunk if out is None else out.unionByName(chunk)
    return out


def distribution_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, moments and tails of a channel, per group."""
    keys = list(keys)
    value = finite(F.col("value"))
    basic = long.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    tails = exact_quantiles(long, keys, "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return basic.join(tails, keys)


def scatter_sample(df: DataFrame, s: Series, x: str, y: str, points: int = 1200) -> DataFrame:
    """Every k-th complete pair of each key."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    numbered = with_ordinal(pairs, s)
    sizes = stage(pairs.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / points))
    return (
        numbered.join(sizes, list(s.keys))
        .where(F.pmod("_ord", step) == 0)
        .select(*s.keys, s.ts, F.col(x).alias("x"), F.col(y).alias("y"))
    )


def quantization_profile(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values and the smallest positive step between sorted ones.

    Neighbours are compared inside value bins, or parts of bins with many values;
    the step across two of them is taken from their end values.
    """
    keys = list(keys)
    values = (
        long.select(*keys, finite(F.col("value")).alias("_v"))
        .where("_v IS NOT NULL")
        .distinct()
        .withColumn("_bin", order_bin(F.col("_v")))
    )
    values = with_parts(values, keys)
    inside = Window.partitionBy(*keys, "_bin", "_part").orderBy("_v")
    steps = values.withColumn("_d", F.col("_v") - F.lag("_v").over(inside))
    bins = steps.groupBy(*keys, "_bin", "_part").agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.min("_d").alias("_d"),
        F.count(F.lit(1)).alias("_c"),
    )
    across = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_bin", "_part"))
    return bins.withColumn("_x", across).groupBy(*keys).agg(
        F.sum("_c").alias("distinct_values"),
        F.min(F.least("_d", "_x")).alias("smallest_increment"),
    )
