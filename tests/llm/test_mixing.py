import re
from collections import defaultdict

from corpus_fixtures import documents, no_documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import mixing


def brute_targets(words):
    """Water filling, one capped source after the other."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_ = sum(words.values()), set(order)
    out = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * words[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 3.0 * words[s]
            left -= 3 * words[s]
        open_ -= full
    return out


def check(rows, got, block):
    words, taken, sizes = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        words[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(words)
    assert len(got) == len(rows)
    for r in got:
        source = None if r._no_source else r._source
        assert r._words == words[source]
        assert abs(r._target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r._taken <= 3 * r._size
        taken[source] += r._taken
        sizes[source] += 1
    for source, target in want.items():
        assert abs(taken[source] - target) <= 4 * block * max(1, len(want)), (source, target, taken[source])


def test_documents(documents, no_documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    got = mixing.mixed(documents, block=4).collect()
    check(rows, got, 4)
    assert sorted(map(str, mixing.mixed(documents.repartition(2), block=4).collect())) == sorted(map(str, got))
    assert mixing.mixed(no_documents).count() == 0


def test_shards_and_mixture(spark):
    rows = [(i, "w " * (i % 50 + 1), ["big", "mid", "low"][0 if i % 3 else i % 2 + 1]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.lit(1))
    got = mixing.mixed(docs, block=8, shard_rows=64).collect()
    check(rows, got, 8 * 12)
    mixture = mixing.mixture(docs, block=8, shard_rows=64)
    assert mixture.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixture.groupBy("doc_id").count().collect()}
    for r in got:
        assert copies.get(r.doc_id, 0) == int(r._taken / r._size + 0.5)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(0, 40)), min_size=1, max_size=12), st.integers(0, 300))
def test_seats_are_the_highest_quotients(spark, parties, seats):
    parties = [(i, float(v), 1000 if m > 30 else m * 10) for i, (v, m) in enumerate(parties)]
    seats = min(seats, sum(m for _, _, m in parties))
    table = spark.createDataFrame(parties, "id int, votes double, most int").withColumn("house", F.lit(seats))
    got = {r.id: r._seats for r in mixing.apportion(table, [], "votes", "house", "most", ["id"]).collect()}
    quotients = sorted((-v / (2 * k + 1), i) for i, v, m in parties for k in range(m))[:seats]
    want = {i: sum(j == i for _, j in quotients) for i, _, _ in parties}
    if all(m == 1000 for _, _, m in parties):
        assert got == want
    assert all(got[i] <= m for i, _, m in parties)
