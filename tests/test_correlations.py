import math
import random


from sensorloom.operators import relations as R

CHANNELS = ["a", "b", "c"]


def table(spark):
    """Ties, missing cells, a NaN, a value below zero, and a group where one channel is constant."""
    r = random.Random(7)
    rows = [
        ("g", *(None if r.random() < 0.2 else float(r.randint(-3, 12)) for _ in CHANNELS))
        for _ in range(400)
    ]
    rows += [("h", 1.0, float(i % 5), float(i)) for i in range(50)]
    rows += [("g", math.nan, 3.0, 4.0)]
    return spark.createDataFrame(rows, "g string, a double, b double, c double")


def test_shared_ranks_give_the_pairwise_correlations(spark):
    df = table(spark)
    pairs = R.channel_pairs(df, ["g"], CHANNELS)
    keys = ["g", "channel_a", "channel_b"]
    want = {
        tuple(r)[:3]: (r.n, r.spearman)
        for r in R.spearman(pairs, keys).collect()
    }
    assert ("h", "b", "c") in want and ("h", "a", "b") not in want
    plain = R.pearson(pairs, keys).where("channel_a <> 'a'").collect()
    for limit in (20_000, 3):
        got = {tuple(r)[:3]: r for r in R.channel_correlations(df, ["g"], CHANNELS, limit=limit).collect()}
        assert set(got) == set(want)
        for k, (n, rho) in want.items():
            assert got[k].n == n and abs(got[k].spearman - rho) < 1e-12
        for r in plain:
            assert abs(got[tuple(r)[:3]].pearson - r.pearson) < 1e-12


def test_each_channel_is_ranked_once(spark):
    """The pairwise form ranks both sides of every pair: two joins of rank tables for each."""
    out = R.correlation_table(table(spark), ["g"], CHANNELS)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1
