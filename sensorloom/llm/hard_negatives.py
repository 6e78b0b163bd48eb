"""Hard-negative mining over zone-mapped blocks in Hilbert order.

Candidates are put in order by label and by their place on a Hilbert curve through the dimensions of
the greatest spread, and cut into Parquet blocks of one label.  Each block has a zone map: the least
and the greatest component in every dimension.  By interval arithmetic a zone map bounds the scores
of all rows of its block:

* for a group of anchors (its box times the block's box) this chooses, before any candidate moves,
  which blocks are read for which group;
* inside, for each anchor, it chooses which of those blocks its windows read, greatest bounds first.

A window asks for the first ``k`` rows by score whose score lies between two bounds.  An anchor's
positives are one window without bounds over the blocks of its label; each positive gives one window
``LOW * positive_score <= 100 * score <= HIGH * positive_score`` over the blocks of other labels.  The
k-th best score so far raises a window's lower bound.  It starts from a few seed blocks that are read
first, so that the choice of blocks does not start blind.  Bounds are widened by their rounding
error; scores are exact integers, so the result is exact whatever the blocks.

Zone maps choose well where vectors cluster.  Over directions without structure every box holds
nearly all scores and nearly all blocks are read.

Components become floor(scale * x).  Defined cases: rows with a null id, label or vector, or with a
null or non-finite component take no part; all rows of an id are candidates (and positives), but none
for an anchor of that id; of several anchor rows with one id the least (by label, then vector) asks; shorter
vectors are filled up with zeros; equal scores go to the smaller id; windows of a negative positive
score are empty; scores beyond 64 bits raise an error; empty tables and anchors without positives give
no rows; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.exact_products import long_scores, matrix, packed, products, unpacked
from sensorloom.llm.tables import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A window reaches from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows of a block for 64 dimensions, blocks whose anchors make one group, and blocks of a cell.
BLOCK_ROWS = 512
GROUP_BLOCKS = 64
CELL_BLOCKS = 16
#: Blocks of each label whose scores seed the windows.
SEED_BLOCKS = 1
CURVE_DIMS, CURVE_BITS = 12, 5


# -- Hilbert order -------------------------------------------------------------------------------


def curve_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers, each below 2**bits.

    Skilling's transformation, for all rows at once.
    """
    x = cells.astype(np.int64)
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            turned = (x[:, i] & bit) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    place = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[:, i] >> level & 1)
    return place


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (whole numbers as doubles) of the rows that take part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    return (
        vectors.select("vec_id", "label", "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    )


def _floor(x: Column) -> Column:
    """floor(x) as a double, also beyond 64-bit integers, which have no fraction."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _ranges(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of each dimension; 2 * d numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            x = matrix(batch.column(0), d)
            low, high = np.minimum(low, x.min(0, initial=np.inf)), np.maximum(high, x.max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    parts = rows.select("v").mapInArrow(partial, "i bigint, low double, high double")
    found = parts.groupBy("i").agg(F.min("low"), F.max("high")).orderBy("i").collect()
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


# -- blocks --------------------------------------------------------------------------------------

_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("page", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()),
        ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
        ("asking_ids", pa.binary()), ("asking_kind", pa.string()), ("asking", pa.binary()),
    ]
)
_BLOCK_TYPE = (
    "block bigint, page bigint, label bigint, ids binary, kind string, data binary, low array<double>, "
    "high array<double>, asking_ids binary, asking_kind string, asking binary"
)


def _cut(d: int, size: int):
    """Cuts sorted rows into blocks of one label, with their zone maps and their anchors."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, held = 0, []

        def row(label, ids, x, asks):
            own, others = x[asks], x[~asks]
            zone = [others.min(0), others.max(0)] if len(others) else [None, None]
            at = first + number
            page = first + number // GROUP_BLOCKS
            mine = ids[asks].astype("<i8").tobytes()
            return (at, page, label, ids[~asks].astype("<i8").tobytes(), *packed(others), *zone, mine, *packed(own))

        def batch_of(row) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        now = None
        for batch in batches:
            labels = batch.column(0).to_numpy()
            ids, asks = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(3), d)
            edge = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if held and now != labels[a]:
                    yield batch_of(row(now, *map(np.concatenate, zip(*held))))
                    number, held = number + 1, []
                now = labels[a]
                while a < b:
                    room = size - sum(len(h[0]) for h in held)
                    end = min(b, a + room)
                    held.append((ids[a:end], x[a:end], asks[a:end]))
                    if end - a == room:
                        yield batch_of(row(now, *map(np.concatenate, zip(*held))))
                        number, held = number + 1, []
                    a = end
        if held:
            yield batch_of(row(now, *map(np.concatenate, zip(*held))))

    return blocks


_GROUP_TYPE = (
    "page bigint, label bigint, ids array<bigint>, kind string, data binary, low array<double>, high array<double>"
)


def _groups(d: int):
    """The anchors of one page and label, with their box."""

    def gather(rows: pa.Table) -> pa.Table:
        found = rows.to_pylist()
        x = np.concatenate([unpacked(r["asking_kind"], r["asking"], d) for r in found])
        ids = np.concatenate([np.frombuffer(r["asking_ids"], "<i8") for r in found])
        kind, data = packed(x)
        box = [pa.array([m], pa.list_(pa.float64())) for m in (x.min(0), x.max(0))]
        names = ["page", "label", "ids", "kind", "data", "low", "high"]
        key = [pa.array([found[0][k]], pa.int64()) for k in ("page", "label")]
        return pa.table([*key, pa.array([ids]), pa.array([kind]), pa.array([data], pa.binary()), *box], names=names)

    return gather


# -- search --------------------------------------------------------------------------------------

_WINDOW_TYPE = "anchor_id bigint, place int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


class _Best:
    """The first k candidates of one window so far."""

    def __init__(self, window: dict, k: int) -> None:
        self.window, self.k = window, k
        score = window["positive_score"]
        self.low = None if score is None else -(-LOW * score // 100)
        self.high = None if score is None else HIGH * score // 100
        least = [x for x in (self.low, window["least"]) if x is not None]
        #: Scores below this are not wanted.
        self.least = max(least, default=None)
        self.scores: list[int] = []
        self.ids: list[int] = []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        wanted = ids != self.window["anchor_id"]
        if self.least is not None:
            wanted &= scores >= self.least
        if self.high is not None:
            wanted &= scores <= self.high
        at = np.flatnonzero(wanted)
        if not len(at):
            return
        ranked = sorted(zip((-s for s in [*self.scores, *scores[at].tolist()]), [*self.ids, *ids[at].tolist()]))[: self.k]
        self.scores, self.ids = [-s for s, _ in ranked], [i for _, i in ranked]
        if len(ranked) == self.k:
            self.least = max(self.scores[-1], self.scores[-1] if self.least is None else self.least)


def _search(d: int, k: int):
    """All windows of one group of anchors over one cell of blocks."""

    def search(asked: pa.Table, met: pa.Table) -> pa.Table:
        best: list[_Best] = []
        if asked.num_rows and met.num_rows:
            group = asked.to_pylist()[0]
            place = {a: n for n, a in enumerate(group["ids"])}
            best = [_Best(w, k) for w in group["windows"]]
            anchor = np.array([place[b.window["anchor_id"]] for b in best])
            x = unpacked(group["kind"], group["data"], d)
            blocks = met.to_pylist()
            low, high = (np.array([b[name] for b in blocks]) for name in ("low", "high"))
            up, down = np.maximum(x, 0), np.minimum(x, 0)
            slack = 1e-9 * np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T
            most, least = up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack
            for n in np.argsort(-most.max(0), kind="stable"):
                reads = [
                    b
                    for b, a in zip(best, anchor)
                    if (b.least is None or most[a, n] >= b.least) and (b.high is None or least[a, n] <= b.high)
                ]
                if not reads:
                    continue
                own = sorted({place[b.window["anchor_id"]] for b in reads})
                row = {a: m for m, a in enumerate(own)}
                ids = np.frombuffer(blocks[n]["ids"], "<i8")
                scores = products(x[own], unpacked(blocks[n]["kind"], blocks[n]["data"], d))
                for b in reads:
                    b.offer(scores[row[place[b.window["anchor_id"]]]], ids)
        rows = [(b.window, i, s) for b in best for i, s in zip(b.ids, b.scores)]
        names = ("anchor_id", "place", "positive_id", "positive_score")
        columns = [pa.array([w[n] for w, *_ in rows], pa.int32() if n == "place" else pa.int64()) for n in names]
        columns += [pa.array([i for _, i, _ in rows], pa.int64()), long_scores([s for *_, s in rows])]
        return pa.table(columns, names=[*names, "vec_id", "score"])

    return search


def _bound(a_low: str, a_high: str, b_low: str, b_high: str, upper: bool) -> Column:
    """Greatest or least score between two boxes."""
    ends = F.arrays_zip(*(F.col(c).alias(n) for c, n in ((a_low, "p"), (a_high, "q"), (b_low, "r"), (b_high, "s"))))
    pick = F.greatest if upper else F.least
    return F.aggregate(
        ends,
        F.lit(0.0),
        lambda total, e: total + pick(e["p"] * e["r"], e["p"] * e["s"], e["q"] * e["r"], e["q"] * e["s"]),
    )


class Blocks:
    """Candidates as staged blocks, and their anchors as staged groups."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, block_rows: int | None = None) -> None:
        """``vectors`` has ``vec_id``, ``label`` and ``v``."""
        rows = stage(vectors)
        self.d = d = rows.agg(F.max(F.size("v"))).first()[0] or 0
        self.spark = vectors.sparkSession
        if not d:
            return
        size = block_rows or max(16, BLOCK_ROWS * 64 // max(64, d))
        low, high = _ranges(rows, d)
        spread = high - low
        dims = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
        step = np.where(spread[dims] > 0, spread[dims], 1.0)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"), d)[:, dims]
                cells = np.minimum((x - low[dims]) / step * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1)
                place = pa.array(curve_places(cells, CURVE_BITS))
                yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "place"])

        asking = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("f"))
        every = rows.select("label", "vec_id", F.lit(False).alias("asks"), "v").unionAll(
            asking.select("f.label", "vec_id", F.lit(True), "f.v")
        )
        placed = every.mapInArrow(places, "label bigint, vec_id bigint, asks boolean, v array<double>, place bigint")
        order = ["label", "place", "vec_id"]
        sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order, "asks", "v")
        self.blocks = stage(sorted_rows.select("label", "vec_id", "asks", "v").mapInArrow(_cut(d, size), _BLOCK_TYPE))
        asked = self.blocks.where(F.octet_length("asking_ids") > 0)
        self.groups = stage(
            asked.select("page", "label", "asking_ids", "asking_kind", "asking")
            .groupBy("page", "label")
            .applyInArrow(_groups(d), _GROUP_TYPE)
        )
        candidates = self.blocks.where(F.octet_length("ids") > 0)
        self.candidates = candidates.select("block", F.col("label").alias("own_label"), "ids", "kind", "data", "low", "high")
        self.cells = max(1, -(-candidates.count() // CELL_BLOCKS))
        cell = F.pmod(F.xxhash64("block"), F.lit(self.cells)).alias("cell")
        self.zones = self.candidates.select(
            "block", "own_label", F.col("low").alias("z_low"), F.col("high").alias("z_high"), cell
        )
        # The seed blocks of a label are bounded in number.
        rank = F.row_number().over(Window.partitionBy("own_label").orderBy(F.xxhash64("block"), "block"))
        self.seeds = stage(self.zones.withColumn("n", rank).where(F.col("n") <= SEED_BLOCKS).drop("n"))

    def _pairs(self, groups: DataFrame, zones: DataFrame, same_label: bool) -> DataFrame:
        """Groups and the blocks they read: each group goes to each cell, as the search asks for."""
        high, low = F.max("w.high"), F.min("w.low")
        wanted = groups.select(
            "page", "label", F.col("low").alias("g_low"), F.col("high").alias("g_high"),
            F.explode(F.transform("windows", _limits)).alias("w"),
        ).groupBy("page", "label", "g_low", "g_high").agg(high.alias("most"), low.alias("least"))
        sent = wanted.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1)).cast("array<bigint>")))
        joined = sent.join(zones, "cell")
        fits = F.col("label") == F.col("own_label") if same_label else F.col("label") != F.col("own_label")
        upper = _bound("g_low", "g_high", "z_low", "z_high", True)
        lower = _bound("g_low", "g_high", "z_low", "z_high", False)
        slack = 1e-9 * (F.abs(upper) + F.abs(lower)) + 1
        reached = (upper + slack >= F.col("least")) & (lower - slack <= F.col("most"))
        return joined.where(fits & reached).select("page", "label", "cell", "block")

    def _read(self, groups: DataFrame, zones: DataFrame, same_label: bool, k: int) -> DataFrame:
        pairs = self._pairs(groups, zones, same_label)
        key = ["page", "label", "cell"]
        # Both sides come from the pairs, so their keys get names of their own.
        met_key = [f"met_{name}" for name in key]
        met = pairs.join(self.candidates, "block").select(
            *(F.col(a).alias(b) for a, b in zip(key, met_key)), "ids", "kind", "data", "low", "high"
        )
        asked = pairs.select(*key).distinct().join(groups, ["page", "label"])
        return (
            asked.select(*key, "ids", "kind", "data", "windows")
            .groupBy(*key)
            .cogroup(met.groupBy(*met_key))
            .applyInArrow(_search(self.d, k), _WINDOW_TYPE)
        )

    def first(self, windows: DataFrame, same_label: bool, k: int) -> DataFrame:
        """The first k rows of each window, with their ``rank``.

        A window has ``anchor_id`` and the anchor's ``page`` and ``label``, ``place`` among the
        anchor's windows, ``positive_id`` and ``positive_score``."""

        def grouped(least: Column, rows: DataFrame) -> DataFrame:
            window = F.struct("anchor_id", "place", "positive_id", "positive_score", least.cast("long").alias("least"))
            gathered = rows.groupBy("page", "label").agg(F.collect_list(window).alias("windows"))
            return stage(self.groups.join(gathered, ["page", "label"]))

        seeded = self._read(grouped(F.lit(None), windows), self.seeds, same_label, k)
        name = ["anchor_id", "place"]
        least = seeded.groupBy(*name).agg(F.when(F.count("*") >= k, F.min("score")).alias("_least"))
        known = windows.join(least, name, "left")
        found = self._read(grouped(F.col("_least"), known), self.zones, same_label, k)
        rank = F.row_number().over(Window.partitionBy(*name).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _limits(window: Column) -> Column:
    """Scores that a window can still use, as doubles without an end where there is none."""
    score = window["positive_score"].cast("double")
    low = F.coalesce(F.greatest(LOW * score / 100, window["least"].cast("double")), F.lit(float("-inf")))
    return F.struct(low.alias("low"), F.coalesce(HIGH * score / 100, F.lit(float("inf"))).alias("high"))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and
    ``negative_score`` of the first negatives of every positive of every anchor."""
    blocks = Blocks(integer_vectors(vectors, scale), is_anchor, block_rows)
    types = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not blocks.d:
        return blocks.spark.createDataFrame([], types)
    anchors = blocks.groups.select("page", "label", F.explode("ids").alias("anchor_id"))
    none = F.lit(None).cast("long")
    open_windows = anchors.select("*", F.lit(0).alias("place"), none.alias("positive_id"), none.alias("positive_score"))
    best = blocks.first(open_windows, same_label=True, k=positives)
    # A negative positive score leaves no room between its bounds.
    own = stage(
        best.where(F.col("score") >= 0)
        .select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(anchors, "anchor_id")
        .select("page", "label", "anchor_id", "place", "positive_id", "positive_score")
    )
    return blocks.first(own, same_label=False, k=negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
