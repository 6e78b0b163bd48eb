import pytest

TEXTS = [
    "The cat sat on the mat. It is the best day for a walk in the park today, they said.",
    "the cat sat on the mat. It is the best day for a walk in the park today, they said!",
    "",
    None,
    "one",
    "Mail a.b+c@x-y.example.org or +49 (0)30 123-4567, card 4111 1111 1111 1111, host 10.0.0.255.",
    "été À la forêt « très » 漢字 🙂 naïve",
    " \t\n ",
    "word " * 3000,
    "x" * 200_000,
]


def document_rows():
    """Nulls everywhere, ties, repeated rows and ids, empty and long texts, clashing columns."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "ö"][i % 4]) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (0, "another text with the id of a row", None, "a"), (None, None, None, None)]
    rows += [(None, TEXTS[0], "en", "b"), (None, "only here", "en", "a"), (50, TEXTS[4], "en", "b")]
    return rows


EXTRA = "score double, rank int, n_words long, size long, kept boolean, start long"


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(*r, len(r[1] or ""), 0.5, 1, 2, 3, True, 4) for r in document_rows()]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark, documents):
    return spark.createDataFrame([], documents.schema)
