"""Exact order statistics that never gather a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
which fails when one sensor holds a large share of the rows.  The functions here
first count values per *order bin* (a monotone, logarithmic bucket of the
value), which is a tiny map-side-combined aggregate, find the bins that hold the
wanted ranks, and only then look at the distinct values inside those bins.  A bin
of many rows, as values in a narrow range give, is cut into equal parts between
its smallest and its largest value, one per ``PART_ROWS`` rows, so that no task
sorts a whole bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.staging import stage

BINS_PER_OCTAVE = 256
# Larger than 1075 * BINS_PER_OCTAVE, so that the sign decides the bin's sign.
BIN_OFFSET = 300_000
PART_ROWS = 20_000


def order_bin(value: Column) -> Column:
    """Monotone bucket of a finite double; equal values share a bucket."""
    magnitude = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + BIN_OFFSET
    return (
        F.when(value == 0, F.lit(0).cast("long"))
        .when(value > 0, magnitude)
        .otherwise(-magnitude)
    )


def finite(value: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _binned(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    clean = df.select(*keys, finite(F.col(value).cast("double")).alias("_v"))
    return clean.where(F.col("_v").isNotNull()).withColumn("_bin", order_bin(F.col("_v")))


def _bin_ranges(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First rank (``_lo``), past-the-end rank (``_hi``), group size, least and largest value of
    each bin, and the number of its parts."""
    counts = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last")
    )
    running = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        "_bin",
        (F.sum("_c").over(running) - F.col("_c")).alias("_lo"),
        F.sum("_c").over(running).alias("_hi"),
        F.sum("_c").over(whole).alias("_n"),
        "_first",
        "_last",
        F.ceil(F.col("_c") / PART_ROWS).alias("_parts"),
    )


def _part() -> Column:
    """Part of a value inside its bin; monotone in the value."""
    share = (F.col("_v") - F.col("_first")) / F.nullif(F.col("_last") - F.col("_first"), F.lit(0.0))
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)
    return F.coalesce(F.when(F.col("_parts") > 1, part), F.lit(0)).cast("long")


def _part_starts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and past-the-end rank of each part, from counted values with ``_lo`` of their bin."""
    parts = values.groupBy(*keys, "_bin", "_part", "_lo").agg(F.sum("_c").alias("_rows"))
    until = F.sum("_rows").over(Window.partitionBy(*keys, "_bin").orderBy("_part"))
    return parts.select(
        *keys,
        "_bin",
        "_part",
        (F.col("_lo") + until - F.col("_rows")).alias("_start_rank"),
        (F.col("_lo") + until).alias("_end_rank"),
    )


def with_parts(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the ``_part`` of each row of ``_v`` inside its ``_bin``."""
    ranges = _bin_ranges(binned, keys).select(*keys, "_bin", "_first", "_last", "_parts")
    return binned.join(ranges, [*keys, "_bin"]).withColumn("_part", _part()).drop("_first", "_last", "_parts")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group.

    ``probs`` maps output column names to probabilities.  Groups without a
    finite value do not appear.
    """
    keys = list(keys)
    single = not keys
    if single:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    binned = _binned(df, keys, value)
    ranges = _bin_ranges(binned, keys)
    names = list(probs)
    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs.values()]
    wanted_ranks = [F.floor(x) for x in positions] + [F.ceil(x) for x in positions]
    hit = F.exists(
        F.array(*wanted_ranks), lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    )
    # At most two bins per group and probability.  Staged, its size is known when
    # the join is planned: below the broadcast threshold the values are filtered
    # where they are read, above it they are shuffled.
    targets = stage(ranges.where(hit).drop("_hi"))
    members = binned.join(targets, [*keys, "_bin"]).withColumn("_part", _part())
    place = [*keys, "_bin", "_part"]
    values = members.groupBy(*place, "_lo", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    first = F.col("_lo")
    if targets.agg(F.max("_parts")).first()[0] not in (None, 1):
        wanted = F.exists(
            F.array(*wanted_ranks),
            lambda r: (r >= F.col("_start_rank")) & (r < F.col("_end_rank")),
        )
        values = values.join(_part_starts(values, keys), place).where(wanted)
        first = F.col("_start_rank")
    inside = Window.partitionBy(*place).orderBy("_v")
    ranked = values.withColumn("_end", first + F.sum("_c").over(inside)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(x)).alias(f"_f{i}") for i, x in enumerate(positions)],
        *[at(F.ceil(x)).alias(f"_g{i}") for i, x in enumerate(positions)],
    )
    out = picked.select(
        *([] if single else keys),
        *[
            (
                F.col(f"_f{i}")
                + (F.col(f"_g{i}") - F.col(f"_f{i}")) * (positions[i] - F.floor(positions[i]))
            ).alias(name)
            for i, name in enumerate(names)
        ],
    )
    # One row per group, staged for the same reason: callers join it to the rows.
    return stage(out)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: count, average rank, group size.

    Ranks start at 1; ties share the mean of their ranks.
    """
    keys = list(keys)
    binned = _binned(df, keys, value)
    ranges = _bin_ranges(binned, keys).drop("_hi")
    values = binned.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = values.join(ranges.hint("merge"), [*keys, "_bin"]).withColumn("_part", _part())
    place = [*keys, "_bin", "_part"]
    inside = Window.partitionBy(*place).orderBy("_v")
    placed = values.join(_part_starts(values, keys).hint("merge"), place).withColumn(
        "_end", F.col("_start_rank") + F.sum("_c").over(inside)
    )
    return placed.select(
        *keys,
        F.col("_v").alias(value),
        F.col("_c").alias("value_count"),
        F.col("_end").alias("rank_last"),
        (F.col("_end") - (F.col("_c") - 1) / 2).alias("average_rank"),
        F.col("_n").alias("group_size"),
    )


def counted_ranks(
    counts: DataFrame, keys: Sequence[str], weights: dict[str, str], limit: int = PART_ROWS
) -> DataFrame:
    """Average ranks of distinct finite values ``_v`` that are counted already, one per count.

    ``weights`` maps output names to count columns, such as the rows of a value that also hold
    another column.  Groups of at most ``limit`` values are sorted whole, others by bins and parts.
    """
    keys, sums = list(keys), list(weights.values())
    large = stage(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit))
    binned = counts.join(large, keys, "left").withColumn(
        "_bin", F.when(F.col("_n").isNotNull(), order_bin(F.col("_v"))).otherwise(F.lit(0).cast("long"))
    ).drop("_n")
    ranges = stage(
        binned.groupBy(*keys, "_bin").agg(
            F.min("_v").alias("_first"), F.max("_v").alias("_last"),
            F.ceil(F.count(F.lit(1)) / limit).alias("_parts"),
        )
    )
    placed = binned.join(ranges, [*keys, "_bin"]).withColumn("_part", _part()).drop("_first", "_last", "_parts")
    spot = [*keys, "_bin", "_part"]
    running = Window.partitionBy(*keys).orderBy("_bin", "_part")
    totals = placed.groupBy(*spot).agg(*[F.sum(c).alias(c) for c in sums])
    starts = stage(totals.select(*spot, *[(F.sum(c).over(running) - F.col(c)).alias(f"_s{c}") for c in sums]))
    inside = Window.partitionBy(*spot).orderBy("_v")

    def rank(c: str) -> Column:
        return F.col(f"_s{c}") + F.sum(c).over(inside) - (F.col(c) - 1) / 2

    return placed.join(starts, spot).select(*keys, "_v", *[rank(c).alias(out) for out, c in weights.items()])


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the tie-averaged rank of ``value`` inside its group.

    The rank table holds distinct values only, so a value that makes up a third
    of the rows is one row there; AQE splits the hot side of the join.
    """
    ranks = value_ranks(df, keys, value).select(
        *keys, F.col(value).alias("_rv"), F.col("average_rank").alias(out)
    )
    left = df.withColumn("_rv", F.col(value).cast("double") + F.lit(0.0))
    # Merged: the planner knows neither how many rows an explode gives nor how many values they
    # hold, and would send a rank table through the driver.
    return left.join(ranks.hint("merge"), [*keys, "_rv"], "left").drop("_rv")


def bin_cuts(df: DataFrame, keys: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """The least value of each equal-frequency bin but the first, one array per group.

    Bins follow the tie-averaged rank, so equal values share one, and the bin of a value is the
    number of cuts not above it.  Only order bins that hold a boundary are read value by value.
    """
    keys = list(keys)
    binned = _binned(df, keys, value)

    def place(rank: Column) -> Column:
        return F.least(F.floor((rank - 0.5) * bins / F.col("_n")), F.lit(bins - 1))

    ranges = stage(
        _bin_ranges(binned, keys)
        .withColumn("_low", place(F.col("_lo") + 1))
        .withColumn("_crossed", F.col("_low") < place(F.col("_hi")))
    )
    whole = ranges.where(~F.col("_crossed")).select(*keys, F.col("_low").alias("_place"), F.col("_first").alias("_v"))
    # At most one order bin per group and boundary; staged, its size is known when it is joined.
    targets = stage(ranges.where("_crossed").drop("_hi", "_low", "_crossed"))
    members = binned.join(targets, [*keys, "_bin"]).withColumn("_part", _part())
    spot = [*keys, "_bin", "_part"]
    values = members.groupBy(*spot, "_lo", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    first = F.col("_lo")
    if targets.agg(F.max("_parts")).first()[0] not in (None, 1):
        values, first = values.join(_part_starts(values, keys).hint("merge"), spot), F.col("_start_rank")
    end = first + F.sum("_c").over(Window.partitionBy(*spot).orderBy("_v"))
    inside = values.withColumn("_place", place(end - (F.col("_c") - 1) / 2)).select(*keys, "_place", "_v")
    least = [F.min(F.when(F.col("_place") >= k, F.col("_v"))) for k in range(1, bins)]
    return whole.unionByName(inside).groupBy(*keys).agg(F.array_compact(F.array(*least)).alias(out))


def robust_scale(
    df: DataFrame, keys: Sequence[str], value: str, factor: float
) -> DataFrame:
    """Median, scaled MAD and quartiles per group, in two selection passes."""
    keys = list(keys)
    center = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    deviations = df.join(center.select(*keys, "median"), keys).withColumn(
        "_dev", F.abs(F.col(value) - F.col("median"))
    )
    mad = exact_quantiles(deviations, keys, "_dev", {"mad": 0.5})
    return center.join(mad, keys).select(
        *keys,
        "median",
        (F.col("mad") * factor).alias("mad"),
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
    )
