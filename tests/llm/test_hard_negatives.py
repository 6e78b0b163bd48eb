import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import hard_negatives as hard
from sensorloom.llm.exact_products import packed, products, unpacked


def brute(rows, modulus, scale=256):
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, label, [math.floor(scale * float(x)) for x in v]))
    first = {}
    for i, label, v in own:
        if i % modulus == 0:
            first[i] = min(first.get(i, (label, v)), (label, v))
    out = []
    for a, (label, x) in first.items():
        scored = [(-sum(p * q for p, q in zip(x, v)), i, own_label) for i, own_label, v in own if i != a]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted((n, j) for n, j, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p)
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(inside[:10])]
    return sorted(out)


def test_curve_visits_neighbours():
    for dims, bits in [(2, 3), (3, 2), (2, 1), (4, 2)]:
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        places = hard.curve_places(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        walk = cells[np.argsort(places)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_products_of_any_size():
    rng = np.random.default_rng(0)
    for size in (1e2, 1e6, 1e9, 1e30):
        a, b = (np.floor(rng.normal(size=(4, 5)) * size) for _ in range(2))
        assert (unpacked(*packed(a), 5) == a).all()
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert products(a, b).tolist() == want


@pytest.mark.parametrize("shape", ["odd", "clusters", "ties", "negative"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    n, d = 240, 6
    x = rng.normal(size=(n, d))
    label = rng.integers(0, 4, n)
    if shape == "clusters":
        x = 4 * rng.normal(size=(4, d))[label] + 0.1 * x
    if shape == "ties":
        x = np.round(x[:6])[rng.integers(0, 6, n)]
    if shape == "negative":
        x = -np.abs(x) * rng.choice([-1, 1], (n, 1))
    rows = [(i, [float(v) for v in u], int(l)) for i, (u, l) in enumerate(zip(x.astype(np.float32), label))]
    if shape == "odd":
        rows += [(None, rows[0][1], 1), (700, None, 1), (710, [None] * d, 1), (720, [math.inf] * d, 1), (740, [1.0], None)]
        rows += [(730, [math.nan] + [1.0] * (d - 1), 1), (750, [2.0, -1.0], 2), (760, [], 1), rows[10], (20, rows[3][1], 3)]
        rows += [(800, [3e4] * d, 2), (801, [2e4] * d, 2), (810, [1.5e4] * d, 9), (-10, rows[4][1], -1)]
    schema = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame(rows, schema).withColumns({"rank": F.lit("x"), "page": F.lit(1), "v": F.lit(2.5)})
    got = hard.mine(table.repartition(3), F.col("vec_id") % 10 == 0, block_rows=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_zone_maps_choose_blocks(spark):
    """Of well separated clusters an anchor's own is read, not the others of its label."""
    rng = np.random.default_rng(1)
    centre = 8 * np.eye(8)[rng.integers(0, 8, 640)]
    x = centre + 0.05 * rng.normal(size=centre.shape)
    rows = [(i, [float(v) for v in u], i % 2) for i, u in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    blocks = hard.Blocks(hard.integer_vectors(table), F.col("vec_id") == 100, block_rows=16)
    asked = blocks.groups.select("page", "label", F.explode("ids").alias("anchor_id"))
    windows = asked.select("*", F.lit(0).alias("place"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"))
    window = F.struct("anchor_id", "place", "positive_id", "positive_score", F.lit(3_000_000).cast("long").alias("least"))
    groups = blocks.groups.join(windows.groupBy("page", "label").agg(F.collect_list(window).alias("windows")), ["page", "label"])
    read = blocks._pairs(groups, blocks.zones, True).count()
    assert 0 < read <= blocks.zones.where("own_label = 0").count() / 3


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        got = hard.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0)
        assert got.columns[:3] == ["anchor_id", "positive_id", "rank"] and got.count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]
    got = hard.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0)
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 2, 65536, 32768)]


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e30], 1), (1, [1e30], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        hard.mine(table, F.col("vec_id") == 0).collect()
