import hashlib
import re
import string

import pytest

from corpus_fixtures import documents, no_documents  # noqa: F401
from sensorloom.llm import decontamination as d

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    ids = ",".join(sorted(map(str, (i for i in found if i is not None))))
    named = len([i for i in found if i is not None])
    return len(own), len(hit), named, hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


ITEMS = [
    (1, "It is the best day for a walk in the park today they said and more"), (2, "THE, cat"), (2, "sat on"),
    (3, None), (4, " .. "), (None, "naïve"), (10, "another text"), (5, "word word word word word word word word word word word word word word"),
]


@pytest.mark.parametrize("window", [3, 13])
def test_equals_brute_force(spark, documents, window):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.judged(documents, bench, window).drop("_doc", "_text_hash").collect()
    rows = documents.select("doc_id", "text").collect()
    want = sorted((str(r[0]), *brute(r[1], ITEMS, window)) for r in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_documents_and_spans_go(spark, documents):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = d.remove_documents(documents, bench)
    assert kept.columns == documents.columns
    assert kept.count() == documents.count() - 5
    cut = {(r.doc_id, r.text) for r in d.remove_spans(documents, bench).select("doc_id", "text").collect()}
    assert (1, "the cat sat on the mat!") in cut and (4, "one") in cut and (3, None) in cut


def test_empty_tables(spark, documents, no_documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.judged(no_documents, bench).count() == 0
    none = spark.createDataFrame([], bench.schema)
    assert d.judged(documents, none).where("n_hit > 0 or contaminated").count() == 0
    assert d.remove_documents(documents, none).count() == documents.count()
