import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import documents, no_documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import id_coder, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_files.TextEncoder(PATH, limit=300)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBé É'.,!|<>\n\tſΣςİ_-1"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_equal_whole_texts(encoder, text):
    assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings(encoder):
    for text in ("<|ENDOFTEXT|> a", "x<|endoftext|>y <|startoftext|>", "ÀB<|Startoftext|>", "...,, It's 'RE"):
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60000), max_size=300), st.integers(1, 70), st.integers(1, 6))
def test_coder_round_trip(ids, block, repeat):
    ids = np.array(ids * repeat, np.int64)
    assert id_coder.decode(id_coder.encode(ids, block)).tolist() == ids.tolist()


def test_coder_compresses_and_detects_damage():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 400_000) % 49408).astype(np.int64)
    data = id_coder.encode(ids)
    assert (id_coder.decode(data) == ids).all() and len(data) < 1.4 * len(ids)
    assert len(id_coder.encode(np.tile(ids[:50], 4000))) < 60_000
    with pytest.raises(id_coder.DamagedBlock):
        id_coder.decode(data[:-300] + bytes(300))


def test_segments_of_any_number_of_blocks(monkeypatch):
    monkeypatch.setattr(id_coder, "MAX_BLOCKS", 3)
    ids = np.random.default_rng(1).integers(0, 50_000, 40 * 7 * 3 + 5)
    data = id_coder.encode(ids, 40)
    assert id_coder.decode(data).tolist() == ids.tolist()


def test_any_damage_spoils_one_block():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 60_000) % 49408).astype(np.int64)
    data = id_coder.encode(ids, 512)
    for place in [0, 20, *rng.integers(0, len(data), 60)]:
        hurt = bytearray(data)
        hurt[place] ^= 0x55
        bad: list[int] = []
        got = id_coder.decode(bytes(hurt), bad)
        assert len(bad) <= 1
        sound = np.ones(len(ids), bool)
        for block in bad:
            sound[block * 512 : (block + 1) * 512] = False
        assert (got[sound] == ids[sound]).all()


def test_query_equals_the_library(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    library = token_files.TextEncoder(PATH).tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = entry.queries()["op9_token_files"](spark, sf).orderBy("doc_id").collect()
    start = 0
    for d, g in zip(docs, got, strict=True):
        ids = [*(library.encode(d.text, add_special_tokens=False).ids if d.text else []), 2]
        assert tuple(g) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files(documents, no_documents):
    segments = token_files.write(documents, PATH, segment_ids=500)
    assert segments.count() >= 3
    got = token_files.read(segments).orderBy("start").collect()
    library = token_files.TextEncoder(PATH).tokenizer
    rows = documents.select("doc_id", "text", F.xxhash64("text", F.col("doc_id").isNull()).alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(g) == (r.doc_id, start, len(ids), crc)
        start += len(ids)
    assert token_files.read(token_files.write(no_documents, PATH)).count() == 0
