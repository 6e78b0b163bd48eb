import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import inner_product


def brute(rows, modulus, k, scale=1024):
    d = max((len(v) for _, v in rows if v), default=0)
    full, asking = [], {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        u = [math.floor(scale * float(x)) for x in v]
        full.append((i, u + [0] * (d - len(u))))
        if i % modulus == 0:
            asking[i] = min(asking.get(i, u), u)
    out = []
    for q, u in asking.items():
        ranked = sorted((-sum(a * b for a, b in zip(u, x)), i) for i, x in full if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["odd", "decay", "flat", "ties"])
def test_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(inner_product, "CHUNK", 37)
    monkeypatch.setattr(inner_product, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    n, d = 300, 12
    x = rng.normal(size=(n, d))
    if shape == "decay":
        x *= 0.5 ** np.arange(d) * rng.lognormal(size=(n, 1))
    if shape == "ties":
        x = np.round(x[:5])[rng.integers(0, 5, n)]
    rows = [(i, [float(v) for v in u]) for i, u in enumerate(x.astype(np.float32))]
    if shape == "odd":
        rows += [(None, rows[0][1]), (700, None), (710, [None] * d), (720, [math.inf] * d), (730, [math.nan] + [1.0] * 11)]
        rows += [(740, [1e6] * d), (741, [1e6, -1e6] * 6), (750, [2.0, -1.0]), (760, []), rows[10], (20, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = inner_product.top_k(table.repartition(3), F.col("vec_id") % 10 == 0, k=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 7)


def test_scores_beyond_64_bits_are_an_error(spark):
    table = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        inner_product.top_k(table, F.col("vec_id") == 0).collect()


def test_short_chunks_are_not_sent(spark, monkeypatch):
    """Only chunks whose length can reach a threshold meet the queries."""
    monkeypatch.setattr(inner_product, "CHUNK", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:200] *= 100
    met = []
    cell = inner_product._cell
    monkeypatch.setattr(inner_product, "_cell", lambda *a: met.append(a) or cell(*a))
    staged = []
    keep = inner_product.stage
    monkeypatch.setattr(inner_product, "stage", lambda df: staged.append(keep(df)) or staged[-1])
    rows = [(i, [float(v) for v in u]) for i, u in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = inner_product.top_k(table, F.col("vec_id") % 20 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 3)
    cells = [df.count() for df in staged if "_slice" in df.columns]
    chunks = next(df.count() for df in staged if "_longest" in df.columns)
    assert len(met) == 2 and cells[0] == 1 and cells[1] < 0.7 * chunks


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0]), (10, [2.0])], schema)
    got = inner_product.top_k(one, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 10, 2097152), (10, 1, 0, 2097152)]
    for rows in ([], [(1, None)], [(1, [1.0]), (2, [1.0])]):
        none = spark.createDataFrame(rows, schema)
        assert inner_product.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
