"""Ordered series operators: segments, exact shifts, time windows, runs.

A series is the rows of one key (usually a sensor) ordered by time.  One sensor
may hold a third of all rows, so no operator here sorts a whole series in one
task.  Series are cut into time blocks:

* operators with a bounded look-back or look-ahead copy only the rows near a
  block edge into the neighbouring block (``time_halo`` and ``row_halo``);
* operators that carry state along the whole series (segment numbers, run
  numbers, row numbers) reduce each block to one summary row, scan the summary
  rows of a key, and join the carried value back (``islands``, ``with_ordinal``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.staging import stage

MINUTE = 60_000_000


@dataclass(frozen=True)
class Series:
    """How to read a table as series.

    ``ties`` are extra ordering columns for rows that share a timestamp.
    ``block_hours`` bounds how much of one key a task sorts at once.
    """

    keys: tuple[str, ...] = ("sensor_id",)
    ts: str = "ts"
    ties: tuple[str, ...] = ()
    cadence_minutes: int = 15
    gap_minutes: int = 90
    block_hours: float = 24 * 7

    @property
    def block_us(self) -> int:
        return max(int(self.block_hours * 60), 1) * MINUTE

    def by(self, *extra: str) -> Series:
        return replace(self, keys=(*self.keys, *extra))


def fit_blocks(df: DataFrame, s: Series, rows: int = 2_000_000) -> Series:
    """Shorten the blocks until the densest one holds about ``rows`` rows.

    One map-side-combined count per key and minute; only its maximum reaches the
    driver.
    """
    minute = bucket_index(micros(s.ts), MINUTE).alias("_minute")
    counts = df.groupBy(*s.keys, minute).agg(F.count(F.lit(1)).alias("_c"))
    hourly = counts.groupBy(*s.keys, bucket_index(F.col("_minute"), 60)).agg(
        F.sum("_c").alias("_h"), F.max("_c").alias("_m")
    )
    per_hour, per_minute = hourly.agg(F.max("_h"), F.max("_m")).first()
    if not per_hour:
        return s
    hours = rows / per_hour
    if hours < 1:
        hours = max(rows / (per_minute * 60), 1 / 60)
    return replace(s, block_hours=min(s.block_hours, hours))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket_index(position: Column, size: int) -> Column:
    """``floor(position / size)`` in whole numbers, exact for any position."""
    return ((position - F.pmod(position, F.lit(size))) / size).cast("long")


def blocked(df: DataFrame, s: Series) -> DataFrame:
    us = micros(s.ts)
    return df.withColumn("_us", us).withColumn("_blk", bucket_index(F.col("_us"), s.block_us))


def _order(s: Series) -> list[str]:
    return ["_us", *s.ties]


def _block_window(s: Series):
    return Window.partitionBy(*s.keys, "_blk").orderBy(*_order(s))


def islands(
    df: DataFrame,
    s: Series,
    carry: Sequence[str],
    starts_new: Callable[[Column, Column], Column],
    out: str,
) -> DataFrame:
    """Number the islands of each series.

    ``starts_new(previous, current)`` decides whether a row opens a new island;
    both arguments are structs with ``_us`` and the ``carry`` columns.  The first
    row of a series always opens one.  Adds ``out`` (1, 2, ...), ``_us``,
    ``_blk`` and ``_prev``, the struct of the previous row.
    """
    keys = list(s.keys)
    fields = ["_us", *carry]
    order = F.struct(*_order(s))
    w = _block_window(s)
    base = blocked(df, s).withColumn("_cur", F.struct(*fields))
    local = base.withColumn("_prev", F.lag("_cur").over(w))
    opens = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(
        F.coalesce(starts_new(F.col("_prev"), F.col("_cur")).cast("int"), F.lit(0))
    )
    summary = local.withColumn("_open", opens).groupBy(*keys, "_blk").agg(
        F.min_by("_cur", order).alias("_first"),
        F.max_by("_cur", order).alias("_last"),
        F.sum("_open").alias("_inside"),
    )
    chain = Window.partitionBy(*keys).orderBy("_blk")
    summary = summary.withColumn("_carry", F.lag("_last").over(chain)).withColumn(
        "_head",
        F.when(F.col("_carry").isNull(), F.lit(1)).otherwise(
            F.coalesce(starts_new(F.col("_carry"), F.col("_first")).cast("int"), F.lit(0))
        ),
    )
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    edges = summary.select(
        *keys,
        "_blk",
        "_carry",
        F.coalesce(F.sum(F.col("_head") + F.col("_inside")).over(before), F.lit(0)).alias("_base"),
    )
    joined = local.join(edges, [*keys, "_blk"]).withColumn(
        "_prev", F.coalesce("_prev", "_carry")
    )
    flag = F.when(F.col("_prev").isNull(), F.lit(1)).otherwise(
        F.coalesce(starts_new(F.col("_prev"), F.col("_cur")).cast("int"), F.lit(0))
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        joined.withColumn("_flag", flag)
        .withColumn(out, F.col("_base") + F.sum("_flag").over(running))
        .drop("_carry", "_base", "_flag", "_cur")
    )


def with_previous(df: DataFrame, s: Series, carry: Sequence[str]) -> DataFrame:
    """Add ``_prev``, the struct (``_us`` and ``carry``) of the previous row."""
    keys = list(s.keys)
    base = blocked(df, s)
    cur = F.struct("_us", *carry)
    order = F.struct(*_order(s))
    last = base.groupBy(*keys, "_blk").agg(F.max_by(cur, order).alias("_last"))
    chain = Window.partitionBy(*keys).orderBy("_blk")
    edges = last.select(*keys, "_blk", F.lag("_last").over(chain).alias("_carry"))
    return (
        base.withColumn("_prev", F.lag(cur).over(_block_window(s)))
        .join(edges, [*keys, "_blk"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .drop("_carry")
    )


def with_next(df: DataFrame, s: Series, carry: Sequence[str]) -> DataFrame:
    """Add ``_next``, the struct (``_us`` and ``carry``) of the following row."""
    keys = list(s.keys)
    base = blocked(df, s)
    cur = F.struct("_us", *carry)
    order = F.struct(*_order(s))
    first = base.groupBy(*keys, "_blk").agg(F.min_by(cur, order).alias("_first"))
    chain = Window.partitionBy(*keys).orderBy("_blk")
    edges = first.select(*keys, "_blk", F.lead("_first").over(chain).alias("_carry"))
    return (
        base.withColumn("_next", F.lead(cur).over(_block_window(s)))
        .join(edges, [*keys, "_blk"])
        .withColumn("_next", F.coalesce("_next", "_carry"))
        .drop("_carry")
    )


def with_ordinal(df: DataFrame, s: Series, out: str = "_ord") -> DataFrame:
    """Add the 0-based row number of each row in its series."""
    keys = list(s.keys)
    base = blocked(df, s)
    sizes = base.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    edges = sizes.select(
        *keys, "_blk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")
    )
    return (
        base.withColumn("_rn", F.row_number().over(_block_window(s)))
        .join(edges, [*keys, "_blk"])
        .withColumn(out, F.col("_base") + F.col("_rn") - 1)
        .drop("_rn", "_base")
    )


def _spread(
    df: DataFrame, s: Series, position: str, back: int, ahead: int, size: int, heavy: bool
) -> DataFrame:
    home = bucket_index(F.col(position), size)
    reach = F.sequence(
        bucket_index(F.col(position) - ahead, size), bucket_index(F.col(position) + back, size)
    )
    spread = df.withColumn("_part", F.explode(reach)).withColumn(
        "_home", F.col("_part") == home
    )
    # One exchange serves every window that partitions by the key and the part.
    # Heavy frames cost far more than their bytes suggest, so their partitions
    # are given by number and not merged by size.
    if heavy:
        count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return spread.repartition(count, *s.keys, "_part")
    return spread.repartition(*s.keys, "_part")


def time_halo(
    df: DataFrame, s: Series, back_minutes: int = 0, ahead_minutes: int = 0, heavy: bool = False,
    size: int | None = None,
) -> DataFrame:
    """Copy rows into every block whose rows can see them through the frame.

    Blocks are as long as the frame at least, unless ``size`` (microseconds) says otherwise.

    Windows over the result partition by ``(*keys, "_part", ...)``; keep the rows
    with ``_home`` afterwards.
    """
    back, ahead = back_minutes * MINUTE, ahead_minutes * MINUTE
    size = size or max(s.block_us, back, ahead)
    base = df if "_us" in df.columns else df.withColumn("_us", micros(s.ts))
    return _spread(base, s, "_us", back, ahead, size, heavy)


def row_halo(
    df: DataFrame, s: Series, back: int = 0, ahead: int = 0, rows: int = 4096, heavy: bool = False
) -> DataFrame:
    """The same by row number; ``df`` must carry ``_ord`` from ``with_ordinal``."""
    return _spread(df, s, "_ord", back, ahead, max(rows, back, ahead), heavy)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_part")


def frame_window(s: Series, *extra: str, order: str = "_us"):
    return Window.partitionBy(*s.keys, "_part", *extra).orderBy(order)


def left_open(w, minutes: int):
    """The frame ``(t - minutes, t]``."""
    return w.rangeBetween(-(minutes * MINUTE - 1), 0)


def segment_series(df: DataFrame, s: Series, out: str = "segment") -> DataFrame:
    """Break series where the gap exceeds ``gap_minutes`` or time does not advance."""
    limit = s.gap_minutes * MINUTE

    def breaks(prev: Column, cur: Column) -> Column:
        delta = cur["_us"] - prev["_us"]
        return (delta > limit) | (delta <= 0)

    numbered = islands(df, s, [], breaks, out)
    return numbered.withColumn(
        "minutes_since_previous", (F.col("_us") - F.col("_prev")["_us"]) / MINUTE
    ).drop("_prev", "_blk")


def segment_id(s: Series, segment: str = "segment") -> Column:
    return F.concat_ws("-", F.col(s.keys[0]).cast("string"), F.col(segment).cast("string"))


def shift_exact(w, value: str | Column, minutes: int) -> Column:
    """The value exactly ``minutes`` later (negative: earlier), else null."""
    offset = minutes * MINUTE
    col = F.col(value) if isinstance(value, str) else value
    return F.max(col).over(w.rangeBetween(offset, offset))


def exact_shifts(
    df: DataFrame, s: Series, wanted: dict[str, tuple[str, int]], segment: str = "segment"
) -> DataFrame:
    """Exact elapsed-time lags (negative minutes) and leads inside segments.

    ``wanted`` maps output names to ``(column, minutes)``; every shift shares one
    exchange and one sort.
    """
    back = max([0, *(-m for _, m in wanted.values())])
    ahead = max([0, *(m for _, m in wanted.values())])
    spread = time_halo(df, s, back, ahead)
    w = frame_window(s, segment)
    out = spread.select(
        "*", *[shift_exact(w, col, minutes).alias(name) for name, (col, minutes) in wanted.items()]
    )
    return home_rows(out)


def window_stat(w, value: str, stat: str) -> Column:
    col = F.col(value)
    if stat == "mean":
        return F.avg(col).over(w)
    if stat == "median":
        return F.percentile(col, 0.5).over(w)
    if stat == "std":
        return F.stddev_samp(col).over(w)
    if stat == "var":
        return F.var_samp(col).over(w)
    if stat == "min":
        return F.min(col).over(w)
    if stat == "max":
        return F.max(col).over(w)
    if stat == "sum":
        return F.sum(col).over(w)
    if stat == "count":
        return F.count(col).over(w)
    raise ValueError(f"unknown statistic: {stat}")


def backward_rolling(
    df: DataFrame,
    s: Series,
    wanted: dict[str, tuple[str, int, str]],
    segment: str | None = "segment",
) -> DataFrame:
    """Left-open backward time windows; ``wanted`` maps name to (column, minutes, stat).

    Medians need their frames in order; ``moving.moving_statistics`` keeps them so.
    """
    names = list(wanted)
    medians = {name: spec for name, spec in wanted.items() if spec[2] == "median"}
    if medians:
        from sensorloom.operators.moving import moving_statistics

        columns = [c for c in df.columns if c != "_us"]
        df = moving_statistics(df, s, medians, segment)
        wanted = {name: spec for name, spec in wanted.items() if name not in medians}
        if not wanted:
            return df
        return backward_rolling(df, s, wanted, segment).select(*columns, "_us", *names)
    back = max(minutes for _, minutes, _ in wanted.values())
    spread = time_halo(df, s, back)
    w = frame_window(s, *([segment] if segment else []))
    out = spread.select(
        "*",
        *[
            window_stat(left_open(w, minutes), col, stat).alias(name)
            for name, (col, minutes, stat) in wanted.items()
        ],
    )
    return home_rows(out)


def resample_grid(
    df: DataFrame, s: Series, aggregates: dict[str, Column], attributes: Sequence[str] = ()
) -> DataFrame:
    """Bucket to the cadence; empty buckets between first and last stay null.

    ``attributes`` are columns that are constant per key.  The raw rows are
    pre-aggregated map-side; the grid is one sequence per key and block, so a
    long series is filled in many tasks.
    """
    keys = list(s.keys)
    width = s.cadence_minutes * MINUTE
    bucket = bucket_index(micros(s.ts), width) * width
    filled = (
        df.withColumn("_us", bucket)
        .groupBy(*keys, *attributes, "_us")
        .agg(*[c.alias(n) for n, c in aggregates.items()])
    )
    return complete_grid(filled, s, list(aggregates), attributes)


def complete_grid(
    df: DataFrame, s: Series, values: Sequence[str], attributes: Sequence[str] = ()
) -> DataFrame:
    """Add a row for every missing bucket of a table that carries ``_us``."""
    keys = [*s.keys, *attributes]
    width = s.cadence_minutes * MINUTE
    span = df.groupBy(*keys).agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"))
    size = max(s.block_us // width, 1) * width
    starts = span.select(
        *keys, "_a", "_b", F.explode(F.sequence("_a", "_b", F.lit(size))).alias("_s")
    )
    grid = starts.select(
        *keys,
        F.explode(
            F.sequence("_s", F.least(F.col("_b"), F.col("_s") + (size - width)), F.lit(width))
        ).alias("_us"),
    )
    # The present buckets union the empty grid: one aggregate, no skewed join.
    empty = grid.select(
        *keys, "_us", *[F.lit(None).cast(df.schema[v].dataType).alias(v) for v in values]
    )
    return (
        df.select(*keys, "_us", *values)
        .unionByName(empty)
        .groupBy(*keys, "_us")
        .agg(*[F.max(v).alias(v) for v in values])
        .withColumn(s.ts, from_micros(F.col("_us")))
    )


def to_long(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Wide channels to ``(ids, channel, value)`` rows, nulls kept."""
    return df.unpivot(list(ids), list(channels), "channel", "value")


def stride_sample(df: DataFrame, s: Series, max_points: int) -> DataFrame:
    """Every k-th row of each series, first to last, with k the least that leaves ``max_points``."""
    numbered = with_ordinal(df, s)
    sizes = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points))
    return (
        numbered.join(sizes, list(s.keys))
        .where(F.pmod("_ord", step) == 0)
        .drop("_n", "_blk", "_us", "_ord")
    )
