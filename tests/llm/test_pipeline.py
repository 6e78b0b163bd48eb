"""The pipeline against its stages in plain Python, with the classifier's own scores."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from corpus_fixtures import documents, no_documents  # noqa: F401
import corpus_pipeline
from sensorloom.llm import mixing, token_files, toxicity
from test_decontamination import brute as contaminated
from test_shingle_dedup import brute as components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for number, (_, function) in enumerate(corpus_pipeline.STAGES, 1):
        made = function(spark, out[-1], SF).cache()
        if number < len(corpus_pipeline.STAGES):
            assert made.schema.simpleString() == docs.schema.simpleString()
        out.append(made)
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(stages[1]) == [r for r in rows(stages[0]) if model.score(r[1]) < 0.5]


def test_one_document_of_each_group_stays(stages):
    before = rows(stages[1])
    kept = {r[0] for r in components(before, 5) if r[3]}
    assert rows(stages[2]) == [r for r in before if r[0] in kept]


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(stages[3]) == [r for r in rows(stages[2]) if not contaminated(r[1], items, 13)[4]]


def test_documents_are_repeated_as_taken(stages):
    want = []
    texts = dict(rows(stages[3]))
    for r in mixing.mixed(stages[3]).collect():
        want += [(r.doc_id, texts[r.doc_id])] * (int(r._taken / r._size + 0.5) if r._size else 0)
    assert rows(stages[4]) == sorted(want)


def test_token_files_of_the_mixture(spark, stages):
    library = token_files.TextEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    start, want = 0, []
    for doc, text in rows(stages[4]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_empty_and_odd_documents(spark, documents, no_documents):
    for docs in (no_documents, documents):
        for number, (_, function) in enumerate(corpus_pipeline.STAGES, 1):
            columns = docs.columns
            docs = function(spark, docs, SF).cache()
            assert number == len(corpus_pipeline.STAGES) or docs.columns == columns
            docs.count()
