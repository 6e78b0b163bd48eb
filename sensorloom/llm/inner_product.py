"""Exact top-k inner product search over norm-sorted vectors.

Vectors are rotated by the eigenvectors of their Gram matrix (the right singular vectors of the
table), sorted by descending length and cut into chunks.  A query meets the chunks in cells of one
query block and one chunk.  In a cell the candidates are processed by descending length, some at a
time; with t the k-th best score so far,

* a query is done as soon as its length times the next candidate's length is below t;
* else the inner product over the leading rotated components plus the product of both residual
  lengths (Cauchy-Schwarz) bounds the score, and only candidates with a bound of t or more get
  their exact integer product.

The thresholds of all cells start from the scores of the longest chunk, which all queries meet
first.  A chunk whose longest vector cannot reach the threshold of any query of a block is not sent
to that block.  Bounds are widened by the rounding error of the rotation, so the result is exact.

Components become floor(scale * x), of any size; scores are exact integers.  Defined cases: null
vectors and vectors with null or non-finite components take no part, nor do rows without an id; all
rows of an id are candidates, but none for a query of that id, for which its smallest vector asks;
a score beyond 64 bits among the best is an error; shorter vectors are filled up with zeros; equal
scores go to the smaller id; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.exact_products import EXACT, long_scores, matrix
from sensorloom.llm.tables import stage

SCALE = 1024
K = 10
CHUNK = 4096
QUERY_BLOCK = 1024
STEP = 512


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v`` (whole numbers as doubles) of the rows that take part."""
    usable = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        # Doubles beyond 2**53 have no fraction, and floor() would cut them to 64 bits.
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
        .withColumns({"vec_id": F.col("vec_id").cast("long"), "v": F.transform("embedding", whole)})
    )


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return matrix(column.combine_chunks(), d)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q and x, pair by pair."""
    if np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    made = [sum(int(a) * int(b) for a, b in zip(p, r)) for p, r in zip(q.tolist(), x.tolist())]
    return np.array([*made, None], object)[:-1]


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, by descending eigenvalue; d * d numbers reach the driver."""

    def partial(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("v")]), d).astype(float)
            total += x.T @ x
        row, column = np.indices((d, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.ravel()), pa.array(column.ravel()), pa.array(total.ravel())], names=["i", "j", "g"]
        )

    parts = vectors.select("v").mapInArrow(partial, "i bigint, j bigint, g double")
    gram = np.zeros((d, d))
    for i, j, g in parts.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[i, j] = g
    return np.linalg.eigh(gram)[1][:, ::-1]


def _keep(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -score))[:k]


def _cell(rotate: np.ndarray, d: int, k: int, head: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        q, x = _matrix(queries["v"], d), _matrix(candidates["v"], d)
        qid, xid = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        order = np.lexsort((xid, -(x.astype(float) ** 2).sum(1)))
        x, xid = x[order], xid[order]
        qr, xr = q @ rotate, x @ rotate
        q_length, x_length = (np.sqrt((m.astype(float) ** 2).sum(1)) for m in (q, x))
        q_rest, x_rest = (np.sqrt((m[:, head:] ** 2).sum(1)) for m in (qr, xr))
        slack = 1e-9 * q_length[:, None]
        start = queries["_least"].to_numpy(zero_copy_only=False).astype(float)
        least = np.where(np.isnan(start), -np.inf, start)
        best_score = [np.zeros(0, np.int64)] * len(q)
        best_id = [np.zeros(0, np.int64)] * len(q)
        live = np.arange(len(q))
        for at in range(0, len(x), STEP):
            live = live[q_length[live] * x_length[at] * (1 + 1e-9) >= least[live]]
            if not len(live):
                break
            part = slice(at, at + STEP)
            bound = qr[live, :head] @ xr[part, :head].T + np.outer(q_rest[live], x_rest[part])
            bound += slack[live] * x_length[part]
            row, column = np.nonzero(bound >= least[live][:, None])
            other = qid[live[row]] != xid[at + column]
            row, column = row[other], column[other]
            score = _products(q[live[row]], x[at + column])
            edge = np.searchsorted(row, np.arange(len(live) + 1))
            for r in range(len(live)):
                a, b = edge[r], edge[r + 1]
                if a == b:
                    continue
                i = live[r]
                s = np.concatenate([best_score[i], score[a:b]])
                n = np.concatenate([best_id[i], xid[at + column[a:b]]])
                top = _keep(s, n, k)
                best_score[i], best_id[i] = s[top], n[top]
                if len(top) == k:
                    least[i] = max(least[i], float(s[top[-1]]))
        sizes = [len(s) for s in best_score]
        scores = long_scores([s for own in best_score for s in own.tolist()])
        return pa.table([np.repeat(qid, sizes), np.concatenate(best_id), scores], names=[n for n, _ in kinds])

    return search


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best other rows of each query row."""
    spark = vectors.sparkSession
    out_type = "query_id bigint, vec_id bigint, score bigint"
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    taking = integer_vectors(vectors, scale).withColumn("_asks", F.coalesce(is_query, F.lit(False)))
    whole = taking.select("vec_id", "v", "_asks", square.alias("_square"))
    ranged = whole.repartitionByRange(F.desc("_square"), "vec_id").withColumn("_part", F.spark_partition_id())
    placed = stage(ranged)
    d = placed.agg(F.max(F.size("v"))).first()[0]
    if not d:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rotate = rotation(placed, d)
    # Half of the components lead; the rest is bounded by its length.
    head = max(1, d // 2)
    # Chunks: consecutive ranks inside a part, so that a chunk holds vectors of like length.
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_square"), "vec_id")) - 1
    chunked = stage(placed.withColumn("_chunk", F.struct("_part", F.floor(rank / CHUNK).alias("_n"))))
    queries = chunked.where("_asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    # Both sides are bounded by these counts; only counts reach the driver.
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocked = stage(
        queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    )
    chunks = stage(chunked.groupBy("_chunk").agg(F.sqrt(F.max("_square")).alias("_longest")))
    longest = chunks.orderBy("_chunk").limit(1)
    head_rows = chunked.join(longest.select("_chunk"), "_chunk").select("vec_id", "v", "_chunk")
    cell = ["_block", "_chunk"]

    def each_block(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn(
            "_block", F.col("_b").cast("long")
        )

    def search(own_queries: DataFrame, own_chunks: DataFrame, rows: DataFrame) -> DataFrame:
        # Each block of queries goes to the chunks that one of its queries can still use: those whose
        # longest vector reaches the least ratio of a threshold to a query's length.
        ratio = F.col("_least") / F.nullif(F.sqrt(square), F.lit(0.0))
        reach = own_queries.groupBy("_block").agg(
            F.min(F.coalesce(ratio, F.lit(float("-inf")))).alias("_ratio")
        )
        slices = max(1, own_chunks.count() // 128)
        listed = stage(
            each_block(own_chunks)
            .join(reach, "_block")
            .where(F.col("_longest") * (1 + 1e-9) >= F.col("_ratio"))
            .select(*cell, F.pmod(F.xxhash64("_chunk"), F.lit(slices)).alias("_slice"))
        )
        # Slices of the chunks keep the rows that a key of this join makes below QUERY_BLOCK * 256.
        asked = own_queries.withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>"))
        ).join(listed, ["_block", "_slice"])
        # Of a chunk there is one row, with as many blocks as there are of queries at most.
        goals = listed.groupBy("_chunk").agg(F.collect_list("_block").alias("_blocks"))
        met = rows.join(goals, "_chunk").withColumn("_block", F.explode("_blocks"))
        return asked.select("vec_id", "v", "_least", *cell).groupBy(*cell).cogroup(
            met.select("vec_id", "v", *cell).groupBy(*cell)
        ).applyInArrow(_cell(rotate, d, k, head), out_type)

    no_least = blocked.withColumn("_least", F.lit(None).cast("double"))
    seeds = search(no_least, longest, head_rows)
    seeded = seeds.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).cast("double").alias("_least")
    )
    ready = stage(blocked.join(seeded.withColumnRenamed("query_id", "vec_id"), "vec_id", "left"))
    found = search(ready, chunks, chunked.select("vec_id", "v", "_chunk"))
    return _first(found, k).select("query_id", "rank", "vec_id", "score")
