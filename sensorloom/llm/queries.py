"""The registered queries of the operators and, where SQL can express it, the SQL beside them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import (
    chat_tree,
    decontamination,
    hard_negatives,
    inner_product,
    language,
    linked_secrets,
    mixing,
    oracles,
    personal_data,
    quality,
    shingle_dedup,
    token_files,
    toxicity,
    turn_repair,
)
from sensorloom.llm.tables import table

#: Rows of an Arrow batch; texts can be long.
ARROW_ROWS = "1000"
RESERVED_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _listed(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text."""

    def listed(spans):
        return F.concat_ws(
            ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base_kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(*base_kinds))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op1_top_k_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector, by integer inner product."""
    _bounded_batches(spark)
    return inner_product.top_k(table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontamination.judged(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_chat_tree(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, and one of control strings, read back from the emitted prefix tree."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(
        F.lit(RESERVED_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat_tree.read_back(chat_tree.build(own.unionByName(made)))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity scores of every document."""
    _bounded_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    score = F.col("score")
    held = F.crc32(F.col("doc_id").cast("string")) % toxicity.MODULUS == toxicity.HELD
    return toxicity.scored(docs, model).select(
        "doc_id", held.alias("held_out"), score, (score >= 0.5).cast("int").alias("predicted")
    )


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of every document."""
    _bounded_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    score = F.col("score")
    held = F.crc32(F.col("doc_id").cast("string")) % quality.MODULUS == quality.HELD
    return quality.scored(docs, model).select(
        "doc_id", held.alias("held_out"), score, (score >= 0.7).cast("int").alias("predicted")
    )


def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in every document."""
    _bounded_batches(spark)
    return _listed(personal_data.find(table(spark, sf, "documents")), personal_data.BASE_KINDS)


def op7_source_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mixture takes from every document."""
    chosen = mixing.mixed(table(spark, sf, "documents"))
    return chosen.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents, on sets of two-word shingles."""
    _bounded_batches(spark)
    found = shingle_dedup.near_duplicates(table(spark, sf, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Token files of all documents, read back."""
    _bounded_batches(spark)
    files = token_files.write(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(files)


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all documents."""
    _bounded_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % language.MODULUS == language.HELD
    return language.predicted(docs, language.train(docs)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


def op11_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by checksum."""
    _bounded_batches(spark)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.report(turn_repair.damaged(turns)).withColumnRenamed("conv_id", "_conv")
    original = turns.select("conv_id").distinct()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return original.join(found, original["conv_id"].eqNullSafe(found["_conv"]), "left").select(
        "conv_id",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after every seventh label moved on."""
    _bounded_batches(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op13_linked_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of secrets and of linked credential parts in every document."""
    _bounded_batches(spark)
    return _listed(linked_secrets.find(table(spark, sf, "documents")), linked_secrets.BASE_KINDS)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k_inner_product, op2_decontamination, op3_chat_tree, op4_toxicity, op5_quality,
        op6_personal_data, op7_source_mixture, op8_near_duplicates, op9_token_files, op10_language,
        op11_turn_repair, op12_hard_negatives, op13_linked_secrets, pipeline,
    )
}

SQL = {
    "op1_top_k_inner_product": oracles.TOP_K,
    "op2_decontamination": oracles.DECONTAMINATION,
    "op3_chat_tree": oracles.CHAT_TREE,
    "op7_source_mixture": oracles.MIXTURE,
    "op8_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_turn_repair": oracles.TURN_REPAIR,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
