import random
import re
import string

import numpy as np
import pytest

from corpus_fixtures import documents, no_documents  # noqa: F401
from sensorloom.llm import shingle_dedup as s
from sensorloom.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    """Components over row numbers; rows with one id are linked."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            alike = a and b and 100 * both >= 80 * (len(a) + len(b) - both)
            if alike or (a and b and rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((doc, len(sets[i]), smallest, doc == smallest))
    return sorted(out, key=str)


def result(docs, n):
    got = s.near_duplicates(docs, shingle=n).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n", [2, 5])
def test_documents(documents, no_documents, n):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert result(documents, n) == brute(rows, n)
    assert result(no_documents, n) == []
    kept = s.one_of_each(documents, shingle=n)
    assert kept.columns == documents.columns
    assert s.one_of_each(no_documents).count() == 0


def test_groups_of_near_copies(spark):
    """Chains, stars, groups that share a passage without being alike, and links near the bound."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, shared = [], [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([1, 3, 20])):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(own)
            base = own if rng.random() < 0.3 else base
    rows += [shared + [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(60)]
    table = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(table)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert result(docs, 2) == brute(table, 2)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 900):
        whole = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        a, b = np.unique(whole[: size + size // 2]), np.unique(whole[size // 2 :])
        t = 400
        x, y = s.sketch(a, t), s.sketch(b, t)
        assert (x != s._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.11
        assert (s.sketch(a[::-1], t) == x).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(3, 3), (61, 60), (200, 201), (201, 200)]
    random.Random(2).shuffle(links)
    got = {r._node: r._component for r in components(spark.createDataFrame(links, "_a long, _b long")).collect()}
    want = {i: 0 for i in range(62)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
