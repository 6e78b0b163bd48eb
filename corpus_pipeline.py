"""A training-corpus pipeline: toxic documents go, one of each group of near duplicates stays,
contaminated documents go, sources are mixed to their weights, and token files are written.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows it
is given and returns a DataFrame, all but the last with the columns of the documents.

Defined cases: a null or empty text is not toxic by itself, has no shingles and so no duplicates, no
words and so no contamination and no share of the mixture, and would be its end id alone in the
files; repeated rows are copies, of which one stays; of equal copies the least id stays; rows without
an id are documents like others and come first in the files; an empty table gives an empty result;
further columns of the documents are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import decontamination, mixing, shingle_dedup, token_files, toxicity
from sensorloom.llm.tables import stage, table

ARROW_ROWS = "1000"
TOXIC_FROM = 0.5
SHINGLE_WORDS = 5
TOKENIZER = "word_bpe_49k.json"

#: SQL cannot express the classifier, the sketches and the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 80 percent or more."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return shingle_dedup.one_of_each(docs, shingle=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark window."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each as often as the mixture repeats it."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: one row per document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return token_files.read(token_files.write(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs)
    return docs
