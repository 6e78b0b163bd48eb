"""Near-duplicate documents: fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles.  The sketch places the set's elements in ``BANDS *
ROWS`` bins, round by round: in round i each element x goes to bin h_i(x) with the value i + v_i(x)
and the smallest value of a bin is kept; the rounds end when all bins are filled.  Round t + j puts
all elements into bin j, so that after 2 t rounds no bin is empty.  Every coordinate is filled and
the share of equal coordinates concentrates around the sets' similarity.  A set of n elements needs
about t ln(t) / n rounds, so the work per document is about max(n, t ln t).

Each band of ``ROWS`` coordinates is a bucket; two sets with similarity 0.8 share none of the buckets
with a probability of (1 - 0.8 ** ROWS) ** BANDS.  Links are confirmed on the full sets:

1. documents with equal sets are one class (its digest is compared, not its members);
2. in each bucket every class is compared with the smallest class of the bucket;
3. the links give components; buckets whose classes all lie in one component are done;
4. in the others, the classes outside the bucket's largest component are compared with those inside
   and with each other, in cells of about two chunks of ``CHUNK`` classes.  A cell returns at most
   one link per class, and no pairs are listed: m classes inside and n outside are (m + n) * n / CHUNK
   rows, and n is small where near copies are linked to the smallest class already.

Defined cases: null or word-less texts have empty sets and are linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows and repeated ids are linked by their id; a row
without an id gets the smallest id of its component, null if there is none, and is kept only in that
case; empty tables give empty tables; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.components import components
from sensorloom.llm.tables import KEY, stage, with_key
from sensorloom.llm.word_arrays import SPACED, mixed, word_hashes

BANDS, ROWS = 32, 5
#: Similarity in percent.
PERCENT = 80
CHUNK = 256

_EMPTY = np.iinfo(np.uint64).max
#: Elements hashed at once; small sets take several rounds together.
_AT_ONCE = 2048


@lru_cache
def _salts(t: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words, _, _ = word_hashes(text, SPACED)
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    # Shorter sequences cannot meet full shingles.
    return np.unique(mixed(total + np.uint64(n)))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The values of the t bins of a non-empty set."""
    out = np.full(t, _EMPTY, np.uint64)
    salts = _salts(t)
    step = -(-_AT_ONCE // len(elements))
    for first in range(0, t, step):
        rounds = np.arange(first, min(first + step, t), dtype=np.uint64)
        h = mixed(elements[None, :] + salts[rounds][:, None])
        # The round stands above 40 bits of value, so a later round never replaces an earlier one.
        value = (rounds << np.uint64(40))[:, None] | (h >> np.uint64(24))
        np.minimum.at(out, (mixed(h) % np.uint64(t)).ravel(), value.ravel())
        if out.max() != _EMPTY:
            return out
    for j in np.flatnonzero(out == _EMPTY):
        least = (mixed(elements + salts[t + j]) >> np.uint64(24)).min()
        out[j] = np.uint64(t + j) << np.uint64(40) | least
    return out


def band_hashes(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = sketch(elements, bands * rows).reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = mixed(total + values[:, k])
    return total.view(np.int64)


def _sets(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, found = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), size)
                count.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                found.append(band_hashes(own, bands, rows) if len(own) else None)
            keep = [batch.column(c) for c in ("_doc", "_text_hash", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["_doc", "_text_hash", "doc_id", "n_shingles", "_digest", "_bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"_doc bigint, _text_hash bigint, doc_id {kind}, n_shingles bigint, _digest binary, _bands array<bigint>"
    )
    return with_key(docs.select("doc_id", "text")).select(*KEY, "doc_id", "text").mapInArrow(scan, schema)


def _pair_links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other.

    Elements on both sides become columns of 0-1 matrices, some thousand columns at a time.
    """
    every = [np.concatenate([*side, np.zeros(0, np.uint64)]) for side in (left, right)]
    common = np.intersect1d(*map(np.unique, every))
    out = np.zeros((len(left), len(right)))
    placed = []
    for side, elements in zip((left, right), every):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        column = np.searchsorted(common, elements)
        known = column < len(common)
        known[known] = common[column[known]] == elements[known]
        order = np.argsort(column[known], kind="stable")
        placed.append((row[known][order], column[known][order], len(side)))
    for first in range(0, len(common), 4096):
        parts = []
        for row, column, height in placed:
            a, b = np.searchsorted(column, (first, first + 4096))
            part = np.zeros((height, 4096), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``_node`` and ``_set`` (bytes) of the wanted classes, computed anew from their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), size).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array(made, pa.binary())], names=["_node", "_set"])

    texts = with_key(docs.select("doc_id", "text")).join(wanted, KEY)
    return texts.select("_node", "text").mapInArrow(scan, "_node bigint, _set binary").dropDuplicates(["_node"])


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``_a``, ``_b``) whose full sets are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _pair_links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("_set"), batch.column("_other"))
            ]
            yield batch.select(["_a", "_b"]).filter(pa.array(good, pa.bool_()))

    # Sizes first: most false candidates differ in size, and need no sets.
    lengths = sets.select(F.col("_node").alias("_n"), F.octet_length("_set").alias("_size"))
    sized = pairs.join(lengths.withColumnsRenamed({"_n": "_a", "_size": "_sa"}), "_a").join(
        lengths.withColumnsRenamed({"_n": "_b", "_size": "_sb"}), "_b"
    )
    alike = sized.where(100 * F.least("_sa", "_sb") >= percent * F.greatest("_sa", "_sb")).select("_a", "_b")
    both = alike.join(sets.withColumnsRenamed({"_node": "_a"}), "_a").join(
        sets.withColumnsRenamed({"_node": "_b", "_set": "_other"}), "_b"
    )
    return both.mapInArrow(verify, "_a bigint, _b bigint")


def _cell_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components in unresolved buckets.

    ``members``: ``_bucket``, ``_node``, ``_component``.
    """
    # The largest component of a bucket is one side; the classes outside it meet it and each other.
    sizes = members.groupBy("_bucket", "_component").agg(F.count("*").alias("_n"))
    sides = sizes.groupBy("_bucket").agg(
        F.max_by("_component", F.struct("_n", "_component")).alias("_main"),
        F.max("_n").alias("_inside"),
        (F.sum("_n") - F.max("_n")).alias("_outside"),
    )

    def chunks(count: str) -> Column:
        return F.ceil(F.col(count) / CHUNK).cast("int")

    draw = F.xxhash64("_bucket", "_node").bitwiseAND(F.lit((1 << 31) - 1))
    inside = F.col("_component") == F.col("_main")
    placed = members.join(sides, "_bucket").withColumn(
        "_chunk", (draw % F.when(inside, chunks("_inside")).otherwise(chunks("_outside"))).cast("int")
    )
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = ["_node", "_component", "_bucket"]
    side = F.lit(0).alias("_side")
    met = placed.where(inside).select(
        *own, F.col("_chunk").alias("_row"), F.explode(upto(chunks("_outside"))).alias("_column"), side
    )
    others = placed.where(~inside)
    meeting = others.select(
        *own, F.explode(upto(chunks("_inside"))).alias("_row"), F.col("_chunk").alias("_column"), F.lit(1).alias("_side")
    )
    # Cells among the others have negative rows.
    among = others.withColumn("_with", F.explode(upto(chunks("_outside")))).select(
        *own,
        (-1 - F.least("_chunk", "_with")).alias("_row"),
        F.greatest("_chunk", "_with").alias("_column"),
        F.col("_chunk").alias("_side"),
    )
    cells = met.unionByName(meeting).unionByName(among)

    def compare(table: pa.Table) -> pa.Table:
        within = -1 - table["_row"][0].as_py() == table["_column"][0].as_py()
        sides = np.array(table["_side"].to_pylist())
        nodes, owner = table["_node"].to_pylist(), table["_component"].to_pylist()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["_set"]]
        left = np.arange(len(own)) if within else np.flatnonzero(sides == sides.min())
        right = left if within else np.flatnonzero(sides != sides.min())
        both = _shared_counts([own[i] for i in left], [own[i] for i in right])
        size = np.array([len(x) for x in own])
        alike = 100 * both >= percent * (size[left][:, None] + size[right] - both)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        found: list[tuple[int, int]] = []
        for i, j in zip(*(side[k] for side, k in zip((left, right), np.nonzero(alike)))):
            a, b = top(owner[i]), top(owner[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((nodes[i], nodes[j]))
        return pa.table(
            {"_a": pa.array([a for a, _ in found], pa.int64()), "_b": pa.array([b for _, b in found], pa.int64())}
        )

    filled = cells.join(sets, "_node")
    return filled.groupBy("_bucket", "_row", "_column").applyInArrow(compare, "_a bigint, _b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: ``KEY``, ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and
    ``_component``, a number of the component (null without words)."""
    found = stage(_sets(docs, shingle, bands, rows))
    # A class is named by a number from its digest.
    full = found.where(F.col("_digest").isNotNull()).withColumn("_node", F.xxhash64("_digest"))
    classes = stage(full.groupBy("_node").agg(F.min(F.struct(*KEY)).alias("_key"), F.first("_bands").alias("_bands")))
    # A repeated id links the classes of its texts.
    named = full.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("_node").alias("_a"))
    several = named.groupBy("_id").agg(F.min("_a").alias("_b"), F.max("_a").alias("_other")).where("_b != _other")
    repeated = named.join(several, "_id").where("_a != _b").select("_a", "_b")
    buckets = classes.select("_node", F.posexplode("_bands").alias("_band", "_hash")).select(
        F.xxhash64("_band", "_hash").alias("_bucket"), "_node"
    )
    shared = stage(
        buckets.groupBy("_bucket")
        .agg(
            F.count("*").alias("_n"),
            F.min("_node").alias("_first"),
            F.bit_xor(F.xxhash64("_node")).alias("_content"),
        )
        .where("_n > 1")
        # Buckets with the same classes lead to the same comparisons.
        .groupBy("_n", "_content", "_first")
        .agg(F.min("_bucket").alias("_bucket"))
        .select("_bucket", "_first")
    )
    members = stage(buckets.join(shared, "_bucket"))
    pairs = members.where("_node != _first").select(F.col("_node").alias("_a"), F.col("_first").alias("_b")).distinct()
    wanted = (
        classes.join(members.select("_node").distinct(), "_node", "left_semi")
        .select("_node", "_key._doc", "_key._text_hash")
    )
    sets = stage(_full_sets(docs, wanted, shingle))
    links = stage(_star_links(pairs, sets, percent).unionByName(repeated))
    first = components(links)
    labelled = members.join(first, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))
    open_buckets = (
        labelled.groupBy("_bucket")
        .agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi"))
        .where("_lo != _hi")
        .select("_bucket")
    )
    rest = stage(labelled.join(open_buckets, "_bucket", "left_semi").select("_bucket", "_node", "_component"))
    more = stage(_cell_links(rest, sets, percent))
    whole = components(links.unionByName(more)) if more.head(1) else first
    own = [*KEY, "doc_id", "n_shingles"]
    labels = full.select(*own, "_node").join(whole, "_node", "left")
    labels = labels.withColumn("_component", F.coalesce("_component", "_node"))
    smallest = labels.groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    linked = labels.join(smallest, "_component").select(*own, "_component", "component_id")
    alone = found.where(F.col("_digest").isNull()).select(
        *own, F.lit(None).cast("long").alias("_component"), F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the smallest id, and one of equal rows."""
    kept = near_duplicates(docs, **options).where("kept")
    linked = kept.where(F.col("_component").isNotNull()).groupBy("_component").agg(F.min(F.struct(*KEY)).alias("_k"))
    alone = kept.where(F.col("_component").isNull()).select(*KEY).distinct()
    chosen = linked.select("_k.*").unionByName(alone)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    return (
        with_key(docs).join(chosen, KEY, "left_semi").withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)
    )
