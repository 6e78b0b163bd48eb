"""Correlation, lag and agreement between channels and between sensors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.quantiles import (
    PART_ROWS, bin_cuts, counted_ranks, exact_quantiles, finite, with_average_rank,
)
from sensorloom.operators.series import (
    MINUTE, Series, exact_shifts, frame_window, from_micros, home_rows, islands, micros,
    shift_exact, time_halo, with_previous,
)
from sensorloom.operators.serving import top_per_group
from sensorloom.sources.staging import stage

#: Readings of one time that a row of ``group_pair_join`` holds at most before pairs are written.
PARTNERS = 256


def channel_pairs(
    df: DataFrame, ids: Sequence[str], channels: Sequence[str], ordered: bool = False,
    first: str | None = None,
) -> DataFrame:
    """``(ids, channel_a, channel_b, x, y)`` for the complete channel pairs of each row.

    With ``first`` only the pairs of that channel with the others.
    """
    picks = permutations(channels, 2) if ordered else combinations(channels, 2)
    if first is not None:
        picks = [(first, c) for c in channels if c != first]
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("channel_a"),
                F.lit(b).alias("channel_b"),
                F.col(a).alias("x"),
                F.col(b).alias("y"),
            )
            for a, b in picks
        ]
    )
    complete = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return df.select(*ids, F.explode(complete).alias("_p")).select(*ids, "_p.*")


def indexed_pairs(
    df: DataFrame,
    ids: Sequence[str],
    left: Sequence[str | Column],
    right: Sequence[str | Column],
    picks: Sequence[tuple[dict, int, int]],
) -> DataFrame:
    """Complete pairs ``x = left[i]``, ``y = right[j]`` for many labelled picks.

    The picks are one constant array, so that hundreds of pairs do not become
    hundreds of expressions.
    """

    def values(columns: Sequence[str | Column]) -> Column:
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        return F.array(*[c.cast("double") for c in cols])

    def literal(value: str | int) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", r"\'") + "'"

    # One parsed expression: hundreds of structs are slow to build call by call.
    structs = (
        "named_struct("
        + ", ".join(f"'{k}', {literal(v)}" for k, v in [*labels.items(), ("_i", i), ("_j", j)])
        + ")"
        for labels, i, j in picks
    )
    table = F.expr(f"array({', '.join(structs)})")
    names = list(picks[0][0])
    rows = df.select(*ids, values(left).alias("_x"), values(right).alias("_y")).select(
        *ids, "_x", "_y", F.explode(table).alias("_p")
    )
    return rows.select(
        *ids,
        *[F.col(f"_p.{n}").alias(n) for n in names],
        F.get("_x", F.col("_p._i")).alias("x"),
        F.get("_y", F.col("_p._j")).alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _varied(x: str, y: str) -> Column:
    return (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))


def correlated(x: str, y: str) -> Column:
    """Pearson correlation; null where a side is constant, which ``corr`` takes for an error."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(pairs: DataFrame, keys: Sequence[str], minimum: int = 30) -> DataFrame:
    """Pearson correlation of ``x`` and ``y`` where both vary."""
    return (
        pairs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            _varied("x", "y").alias("_ok"),
            correlated("x", "y").alias("pearson"),
        )
        .where((F.col("n") >= minimum) & F.col("_ok"))
        .drop("_ok")
    )


def spearman(pairs: DataFrame, keys: Sequence[str], minimum: int = 30) -> DataFrame:
    """Correlation of the tie-averaged ranks of the complete pairs."""
    ranked = with_average_rank(pairs, keys, "x", "_rx")
    ranked = with_average_rank(ranked, keys, "y", "_ry")
    return (
        ranked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            _varied("_rx", "_ry").alias("_ok"),
            correlated("_rx", "_ry").alias("spearman"),
        )
        .where((F.col("n") >= minimum) & F.col("_ok"))
        .drop("_ok")
    )


def channel_correlations(
    df: DataFrame, ids: Sequence[str], channels: Sequence[str], minimum: int = 30, limit: int = PART_ROWS
) -> DataFrame:
    """Pearson and Spearman of the complete pairs of channels in each group, where both vary.

    A channel is ranked once per group and not once per pair: a value's ranks among the rows that
    hold a second channel come from counts per distinct value.  They are merged with the readings,
    which meet again by row; only there are pairs built, and aggregated at once.
    """
    ids, many = list(ids), range(len(channels))
    cells = F.array(*[
        F.struct(F.lit(i).alias("_ch"), (F.col(c).cast("double") + F.lit(0.0)).alias("_v"))
        for i, c in enumerate(channels)
    ])
    held = [F.col(c).isNotNull().cast("long").alias(f"_h{i}") for i, c in enumerate(channels)]
    present = F.explode(F.filter(cells, lambda x: x["_v"].isNotNull())).alias("_x")
    counts = stage(
        df.select(*ids, *held, present)
        .select(*ids, *[f"_h{i}" for i in many], "_x.*")
        .where(finite(F.col("_v")).isNotNull())
        .groupBy(*ids, "_ch", "_v")
        .agg(*[F.sum(f"_h{i}").alias(f"_c{i}") for i in many])
    )
    ranks = counted_ranks(counts, [*ids, "_ch"], {f"_r{i}": f"_c{i}" for i in many}, limit)
    # Numbered before they are taken apart, or each cell would get a number of its own.
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select(*ids, "_row", present).select(*ids, "_row", "_x.*")
    # Merged, as every rank table; the shuffle by row is before the cells become columns.
    ranked = rows.join(ranks.hint("merge"), [*ids, "_ch", "_v"], "left").repartition("_row")
    picks = list(combinations(many, 2))

    def cell(i: int, name: str) -> Column:
        return F.max(F.when(F.col("_ch") == i, F.col(name)))

    wide = ranked.groupBy("_row", *ids).agg(
        *[cell(i, "_v").alias(f"_v{i}") for i in many],
        *[cell(i, f"_r{j}").alias(f"_r{i}_{j}") for i in many for j in many if i != j],
    )
    pairs = F.array(*[
        F.struct(
            F.lit(k).alias("_k"), F.col(f"_v{i}").alias("x"), F.col(f"_v{j}").alias("y"),
            F.col(f"_r{i}_{j}").alias("_rx"), F.col(f"_r{j}_{i}").alias("_ry"),
        )
        for k, (i, j) in enumerate(picks)
    ])
    complete = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    names = [F.array(*[F.lit(channels[p[side]]) for p in picks]) for side in (0, 1)]
    return (
        wide.select(*ids, F.explode(complete).alias("_p"))
        .select(*ids, "_p.*")
        .groupBy(*ids, "_k")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (_varied("x", "y") & _varied("_rx", "_ry")).alias("_ok"),
            correlated("x", "y").alias("pearson"),
            correlated("_rx", "_ry").alias("spearman"),
        )
        .where((F.col("n") >= minimum) & F.col("_ok"))
        .select(
            *ids, F.get(names[0], F.col("_k")).alias("channel_a"), F.get(names[1], F.col("_k")).alias("channel_b"),
            "n", "pearson", "spearman",
        )
    )


def correlation_table(
    df: DataFrame, ids: Sequence[str], channels: Sequence[str], minimum: int = 30
) -> DataFrame:
    """Pearson and Spearman side by side, with the gain of the rank form."""
    return channel_correlations(df, ids, channels, minimum).withColumn(
        "spearman_minus_pearson", F.abs("spearman") - F.abs("pearson")
    )


def matrix_view(table: DataFrame, value: str, channels: Sequence[str]) -> DataFrame:
    """Long pairs to a symmetric matrix with a unit diagonal."""
    pairs = table.select("channel_a", "channel_b", value)
    mirrored = table.select(
        F.col("channel_b").alias("channel_a"), F.col("channel_a").alias("channel_b"), value
    )
    ends = pairs.unionByName(mirrored)
    diagonal = ends.select("channel_a").distinct().select(
        "channel_a", F.col("channel_a").alias("channel_b"), F.lit(1.0).alias(value)
    )
    return (
        ends.unionByName(diagonal)
        .groupBy(F.col("channel_a").alias("channel"))
        .pivot("channel_b", list(channels))
        .agg(F.max(value))
    )


def mutual_information(
    pairs: DataFrame, keys: Sequence[str], bins: int = 8, minimum: int = 100
) -> DataFrame:
    """Mutual information in nats over equal-frequency bins of both values."""
    keys = list(keys)
    pairs = pairs.where(finite(F.col("x").cast("double")).isNotNull() & finite(F.col("y").cast("double")).isNotNull())
    # Two short arrays per group decide the bins of its rows; no rank is joined to a row.
    cuts = stage(bin_cuts(pairs, keys, "x", bins, "_cx").join(bin_cuts(pairs, keys, "y", bins, "_cy"), keys))

    def bin_of(value: str, cut: str) -> Column:
        return F.size(F.filter(cut, lambda c: c <= F.col(value)))

    binned = pairs.join(cuts, keys).select(*keys, bin_of("x", "_cx").alias("_bx"), bin_of("y", "_cy").alias("_by"))
    cells = binned.groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_c"))

    def total(*cols: str) -> Column:
        return F.sum("_c").over(Window.partitionBy(*keys, *cols))

    # The contingency table has at most bins * bins rows per group.
    terms = cells.select(
        *keys,
        "_c",
        total().alias("_n"),
        (total("_bx") * total("_by")).alias("_expected"),
    )
    share = F.col("_c") / F.col("_n")
    return (
        terms.groupBy(*keys)
        .agg(
            F.max("_n").alias("n"),
            F.sum(share * F.log(F.col("_c") * F.col("_n") / F.col("_expected"))).alias(
                "mutual_information"
            ),
        )
        .where(F.col("n") >= minimum)
    )


def lag_pairs(
    df: DataFrame, s: Series, channels: Sequence[str], lags: Sequence[int]
) -> DataFrame:
    """Each channel value with its value ``lag`` minutes earlier."""
    wanted = {f"_{c}_{m}": (c, -m) for c in channels for m in lags}
    wide = exact_shifts(df.withColumn("_seg", F.lit(0)), s, wanted, "_seg")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                F.lit(m).alias("lag_minutes"),
                F.col(c).alias("x"),
                F.col(f"_{c}_{m}").alias("y"),
            )
            for c in channels
            for m in lags
        ]
    )
    complete = F.filter(cells, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return wide.select(*s.keys, F.explode(complete).alias("_p")).select(*s.keys, "_p.*")


def autocorrelation(
    df: DataFrame, s: Series, channels: Sequence[str], lags: Sequence[int], minimum: int = 30
) -> DataFrame:
    """Correlation with the value exactly ``lag`` earlier, per key, channel and lag."""
    pairs = lag_pairs(df, s, channels, lags)
    return pairs.groupBy(*s.keys, "channel", "lag_minutes").agg(
        F.count(F.lit(1)).alias("n"), correlated("x", "y").alias("autocorrelation")
    ).where(F.col("n") >= minimum)


def strongest(table: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the largest absolute score of each group."""
    w = Window.partitionBy(*keys).orderBy(F.abs(score).desc_nulls_last(), *ties)
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cross_correlation(
    df: DataFrame, s: Series, channels: Sequence[str], lags: Sequence[int], minimum: int = 60
) -> DataFrame:
    """Correlation of ``source(t)`` with ``target(t + lag)`` for ordered channel pairs."""
    wanted = {f"_{c}_{i}": (c, m) for c in channels for i, m in enumerate(lags)}
    wide = exact_shifts(df.withColumn("_seg", F.lit(0)), s, wanted, "_seg")
    shifted = [(c, i) for c in channels for i in range(len(lags))]
    picks = [
        (
            {"source": a, "target": b, "lag_minutes": lags[i]},
            list(channels).index(a),
            shifted.index((b, i)),
        )
        for a, b in permutations(channels, 2)
        for i in range(len(lags))
    ]
    pairs = indexed_pairs(wide, s.keys, channels, [f"_{c}_{i}" for c, i in shifted], picks)
    return pearson(pairs, [*s.keys, "source", "target", "lag_minutes"], minimum).withColumnRenamed(
        "pearson", "correlation"
    )


def short_gap_interpolate(
    long: DataFrame, s: Series, limit: int = 2, both: bool = False
) -> DataFrame:
    """Linear fill of at most ``limit`` buckets per gap, on the cadence grid.

    Works on the present values alone: each pair of neighbours yields the filled
    buckets between them.  Like the usual forward fill limit, a long gap gets its
    first ``limit`` buckets only (with ``both`` also its last), and buckets after
    the last value up to the end of the key's grid repeat it.
    """
    by = s.by("channel")
    keys = list(by.keys)
    width = s.cadence_minutes * MINUTE
    present = long.where(F.col("value").isNotNull()).select(*keys, s.ts, "value")
    linked = with_previous(present, by, ["value"])
    missing = F.floor((F.col("_us") - F.col("_prev")["_us"]) / width) - 1
    near = F.col("_i") <= limit
    if both:
        near = near | (F.col("_i") > F.col("_m") - limit)
    head = F.least(F.col("_m"), F.lit(limit))
    steps = F.sequence(F.lit(1).cast("long"), head)
    if both:
        tail = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_m") - limit + 1), F.col("_m"))
        steps = F.array_union(steps, tail)
    inner = (
        linked.withColumn("_m", missing)
        .where(F.col("_m") > 0)
        .withColumn("_i", F.explode(steps))
        .where(near)
        .select(
            *keys,
            (F.col("_prev")["_us"] + F.col("_i") * width).alias("_us"),
            (
                F.col("_prev")["value"]
                + (F.col("value") - F.col("_prev")["value"]) * F.col("_i") / (F.col("_m") + 1)
            ).alias("value"),
        )
    )
    ends = long.withColumn("_us", micros(s.ts)).groupBy(*s.keys).agg(
        F.min("_us").alias("_start"), F.max("_us").alias("_end")
    )
    edges = (
        present.withColumn("_us", micros(s.ts))
        .groupBy(*keys)
        .agg(
            F.max_by("value", "_us").alias("value"), F.max("_us").alias("_last"),
            F.min_by("value", "_us").alias("_v0"), F.min("_us").alias("_first"),
        )
        .join(ends, list(s.keys))
    )
    after = edges.withColumn(
        "_m", F.least(F.lit(limit), F.floor((F.col("_end") - F.col("_last")) / width))
    ).where("_m > 0")
    parts = [
        linked.select(*keys, "_us", "value", F.lit(False).alias("filled")),
        inner.withColumn("filled", F.lit(True)),
        after.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_m"))).select(
            *keys, (F.col("_last") + F.col("_i") * width).alias("_us"), "value",
            F.lit(True).alias("filled"),
        ),
    ]
    if both:
        before = edges.withColumn(
            "_m", F.least(F.lit(limit), F.floor((F.col("_first") - F.col("_start")) / width))
        ).where("_m > 0")
        parts.append(
            before.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_m"))).select(
                *keys, (F.col("_first") - F.col("_i") * width).alias("_us"),
                F.col("_v0").alias("value"), F.lit(True).alias("filled"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn(s.ts, from_micros(F.col("_us"))).drop("_us")


def complete_runs(filled: DataFrame, s: Series) -> DataFrame:
    """Number the runs of consecutive buckets of each key and channel."""
    by = s.by("channel")
    width = s.cadence_minutes * MINUTE
    return islands(
        filled, by, [], lambda p, c: (c["_us"] - p["_us"]) != width, "run"
    ).drop("_prev", "_blk")


def longest_run(filled: DataFrame, s: Series) -> DataFrame:
    """Rows of the longest complete run (earliest on ties) per key and channel."""
    by = [*s.keys, "channel"]
    runs = stage(complete_runs(filled, s))
    sizes = runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("run_length"))
    best = sizes.groupBy(*by).agg(
        F.max_by("run", F.struct(F.col("run_length"), -F.col("run"))).alias("run"),
        F.max("run_length").alias("run_length"),
    )
    return runs.join(best, [*by, "run"])


def partial_autocorrelation(runs: DataFrame, s: Series, max_lag: int) -> DataFrame:
    """Yule-Walker partial autocorrelation of each series' longest complete run.

    The autocovariances are grouped sums in Spark; the Durbin-Levinson recursion
    folds the short array of autocorrelations of each series.
    """
    by = s.by("channel")
    keys = list(by.keys)
    means = runs.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n")
    )
    centred = runs.join(means, keys).withColumn("_c", F.col("value") - F.col("_mean"))
    lags = range(1, max_lag + 1)
    spread = time_halo(centred, by, max_lag * s.cadence_minutes)
    w = frame_window(by)
    wide = home_rows(
        spread.select(
            "*",
            *[shift_exact(w, "_c", -k * s.cadence_minutes).alias(f"_l{k}") for k in lags],
        )
    )
    cov = wide.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_g{k}") for k in lags],
    )
    usable = cov.where(F.col("_g0") > 0).select(
        *keys, "n", F.array(*[F.col(f"_g{k}") / F.col("_g0") for k in lags]).alias("_r")
    )
    r = F.col("_r")
    empty = F.expr("cast(array() as array<double>)")

    def step(acc: Column, k: Column) -> Column:
        prior = acc["phi"]
        # r_{k-1}, ..., r_1 against phi_{k-1,1}, ..., phi_{k-1,k-1}
        earlier = F.slice(r, F.lit(1), k - 1)
        dot_rev = F.aggregate(
            F.zip_with(prior, F.reverse(earlier), lambda p, q: p * q), F.lit(0.0),
            lambda a, b: a + b,
        )
        dot = F.aggregate(
            F.zip_with(prior, earlier, lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b
        )
        last = F.try_divide(F.element_at(r, k) - dot_rev, 1 - dot)
        updated = F.zip_with(prior, F.reverse(prior), lambda p, q: p - last * q)
        return F.struct(
            F.concat(updated, F.array(last)).alias("phi"),
            F.concat(acc["out"], F.array(last)).alias("out"),
        )

    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(max_lag)),
        F.struct(empty.alias("phi"), empty.alias("out")),
        step,
        lambda acc: acc["out"],
    )
    return usable.select(*keys, "n", F.posexplode(folded).alias("_k", "pacf")).select(
        *keys, "n", (F.col("_k") + 1).alias("lag"), "pacf"
    )


def sensor_pairs(sensors: DataFrame, group: str, sensor: str = "sensor_id") -> DataFrame:
    """The pairs ``a < b`` of one group, from a table of sensors (not of readings)."""
    a = sensors.select(group, F.col(sensor).alias("sensor_a")).distinct()
    b = sensors.select(group, F.col(sensor).alias("sensor_b")).distinct()
    return a.join(b, group).where("sensor_a < sensor_b").select("sensor_a", "sensor_b")


def pairwise_sensor_join(long: DataFrame, pairs: DataFrame, ts: str = "ts") -> DataFrame:
    """Both sensors' values at the same time, for the listed pairs of sensors.

    Each reading meets only the partners listed for its sensor, through equi
    joins; readings of unlisted sensors are dropped before the shuffle.
    """
    present = long.where(F.col("value").isNotNull()).select("sensor_id", "channel", ts, "value")
    left = present.join(pairs, present.sensor_id == pairs.sensor_a).select(
        "sensor_a", "sensor_b", "channel", ts, F.col("value").alias("x")
    )
    right = present.select(
        F.col("sensor_id").alias("sensor_b"), "channel", ts, F.col("value").alias("y")
    )
    return left.join(right, ["sensor_b", "channel", ts])


def group_pair_join(
    long: DataFrame, group: str, ts: str = "ts", either: DataFrame | None = None, partners: int = PARTNERS
) -> DataFrame:
    """Both values at the same time for all pairs of sensors of a group.

    Readings meet on group, channel and time, so only they are shuffled, not the pairs; the result
    has one row per pair and common time.  The readings of a time are gathered in the order of
    sensors, ``partners`` in an array, so a reading passes over the arrays of lesser sensors whole.
    With ``either`` only pairs with one of its sensors.
    """
    keys = [group, "channel", ts]
    present = long.where(F.col("value").isNotNull() & F.col("sensor_id").isNotNull()).select(
        group, "sensor_id", "channel", ts, "value"
    )
    if either is not None:
        present = present.join(either.withColumn("_one", F.lit(True)), [group, "sensor_id"], "left")
    flag = [] if either is None else ["_one"]
    # The pairs exceed by far what the bytes of the readings suggest, so partitions are not merged by size.
    count = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = present.repartition(count, *keys)
    left = dealt.select(*keys, F.col("sensor_id").alias("sensor_a"), F.col("value").alias("x"), *flag)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("sensor_id"))
    right = (
        dealt.withColumn("_part", F.floor((place - 1) / partners))
        .groupBy(*keys, "_part")
        .agg(
            F.max("sensor_id").alias("_last"),
            F.collect_list(
                F.struct(
                    F.col("sensor_id").alias("sensor_b"), F.col("value").alias("y"),
                    *[F.col(c).alias("_two") for c in flag],
                )
            ).alias("_others"),
        )
    )
    # Merged, so that one time's readings are the most a task holds.
    met = (
        left.join(right.hint("merge"), keys)
        .where("sensor_a < _last")
        .select("channel", ts, "sensor_a", "x", *flag, F.inline("_others"))
        .where("sensor_a < sensor_b")
    )
    if either is not None:
        met = met.where("_one OR _two")
    return met.select("sensor_b", "channel", ts, "sensor_a", "x", "y")


def pair_agreement(paired: DataFrame) -> DataFrame:
    """Correlation and difference statistics per sensor pair and channel."""
    keys = ["sensor_a", "sensor_b", "channel"]
    diff = F.col("x") - F.col("y")
    middle = F.nullif((F.abs("x") + F.abs("y")) / 2, F.lit(0.0))
    rows = paired.withColumn("_abs", F.abs(diff))
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap_count"),
        F.avg("_abs").alias("mae"),
        F.avg(diff).alias("mean_difference"),
        F.stddev_samp(diff).alias("difference_std"),
        F.avg(F.col("_abs") / middle).alias("mean_relative_difference"),
    )
    return (
        basic.join(
            exact_quantiles(rows, keys, "_abs", {"median_absolute_difference": 0.5}), keys
        )
        .join(pearson(rows, keys, 3).drop("n"), keys, "left")
        .join(spearman(rows, keys, 3).drop("n"), keys, "left")
    )


def leave_one_out_median(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Median of the other rows' values inside a group, without pairing rows.

    With the group sorted, leaving out rank ``r`` of ``n`` shifts the middle
    position by one when ``r`` is at or below it, so two neighbouring order
    statistics per row are enough.  A group is one timestamp of one network, so
    its size is the number of sensors reporting then.
    """
    part = Window.partitionBy(*group)
    n, r = F.count(F.lit(1)).over(part), F.row_number().over(part.orderBy(value))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", n).withColumn("_r", r)
    # Middle ranks of the n - 1 others, counted among the others.
    lo, hi = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)
    for name, rank in (("_a", lo), ("_b", hi)):
        # Candidates: the value at that rank and at the next, constant per group.
        ranked = ranked.withColumn(
            name,
            F.max(F.when(F.col("_r") == rank, F.col(value))).over(part),
        ).withColumn(
            name + "1",
            F.max(F.when(F.col("_r") == rank + 1, F.col(value))).over(part),
        )
    low = F.when(F.col("_r") <= lo, F.col("_a1")).otherwise(F.col("_a"))
    high = F.when(F.col("_r") <= hi, F.col("_b1")).otherwise(F.col("_b"))
    return ranked.withColumn(out, F.when(F.col("_n") > 1, (low + high) / 2)).drop(
        "_n", "_r", "_a", "_a1", "_b", "_b1"
    )


def peer_residual(
    df: DataFrame, group: str, value: str, minimum_sensors: int = 3, sensor: str = "sensor_id",
    ts: str = "ts",
) -> DataFrame:
    """Value minus the median of the group's other sensors at the same time.

    Groups with fewer than ``minimum_sensors`` sensors have no residuals.
    """
    large = stage(
        df.select(group, sensor)
        .distinct()
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("_k"))
        .where(F.col("_k") >= minimum_sensors)
        .select(group)
    )
    members = df.join(large, group, "left_semi")
    out = leave_one_out_median(members, [group, ts], value, "peer_median")
    return out.where(F.col("peer_median").isNotNull()).withColumn(
        "residual", F.col(value) - F.col("peer_median")
    )


def change_profile(
    df: DataFrame, s: Series, channel: str, lags: Sequence[int], segment: str = "segment"
) -> tuple[DataFrame, DataFrame]:
    """Two tables per key and lag: change statistics, and the five largest moves each way."""
    wanted = {f"_l{m}": (channel, -m) for m in lags}
    wide = exact_shifts(df, s, wanted, segment)
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("lag_minutes"), F.col(channel).alias("x"), F.col(f"_l{m}").alias("y"))
            for m in lags
        ]
    )
    complete = F.filter(cells, lambda c: c["x"].isNotNull() & c["y"].isNotNull())
    rows = wide.select(*s.keys, s.ts, F.explode(complete).alias("_c")).select(
        *s.keys, s.ts, "_c.*", (F.col("_c.x") - F.col("_c.y")).alias("change")
    ).withColumn("_abs", F.abs("change"))
    keys = [*s.keys, "lag_minutes"]
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        correlated("x", "y").alias("autocorrelation"),
        F.avg("_abs").alias("mean_absolute_change"),
    )
    middle = exact_quantiles(rows, keys, "_abs", {"median_absolute_change": 0.5})
    return basic.join(middle, keys), _extreme_changes(rows, keys, s.ts)


def _extreme_changes(rows: DataFrame, keys: Sequence[str], ts: str, n: int = 5) -> DataFrame:
    def ranked(order: Column, direction: str) -> DataFrame:
        return top_per_group(rows, keys, n, order, F.col(ts)).select(
            *keys, F.lit(direction).alias("direction"), "rank", ts, "change"
        )

    return ranked(F.col("change"), "negative").unionByName(
        ranked(F.col("change").desc(), "positive")
    )
