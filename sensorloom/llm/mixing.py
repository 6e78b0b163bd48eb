"""Mixing sources to target weights with Sainte-Lague apportionment.

Sources take fixed weights in code-point order.  Their targets share the words of the corpus by
weight, capped at ``MOST_REPEATS`` times a source's own words (``targets``).  Equal blocks of
``block`` words are then dealt to the sources by the highest quotients target / (2 k + 1), and the
blocks of a source in the same way to its shards.  A shard is a bounded, hashed part of a source's
documents in seeded order; its quota takes whole passes over the shard and then the first blocks of
the seeded order.

The highest quotients are found without dealing seat by seat: with n parties and m seats a party
of share p has at least p (m - n / 2) - 1/2 seats, so only some 3 n quotients have to be ranked.

Only DataFrame expressions are used.  Defined cases: a null text has size 0 and takes nothing; the
null source is a source of its own, after the others; sources without words have target 0; repeated
rows count and are taken one by one; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.tables import KEY, stage, with_key

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the first, second, third ... source, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 32
SHARD_ROWS = 4096
SEED = "mixture-1"

_SOURCE = ["_no_source", "_source"]


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return with_key(docs).select(
        *KEY,
        "doc_id",
        F.col("source").isNull().alias("_no_source"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``_rank``, ``_weight``, ``_words``, ``_rows``, ``_total``, ``_target``.

    The level is the words per unit of weight; a source is full where the level that the remaining
    sources would have reaches its cap, and these are the first in the order of cap per weight.
    """
    own = sized.groupBy(*_SOURCE).agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"))
    rank = F.row_number().over(Window.orderBy(*_SOURCE))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1)
    ranked = own.withColumn("_rank", rank).withColumn("_weight", weight.cast("long"))
    cap = MOST_REPEATS * F.col("_words")
    by_cap = Window.orderBy(cap / F.col("_weight"), "_rank")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    later = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    filled = ranked.withColumn("_total", F.sum("_words").over(whole)).withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum(cap).over(earlier), F.lit(0))) / F.sum("_weight").over(later),
    )
    level = F.max("_level").over(whole)
    return filled.withColumn("_target", F.least(cap.cast("double"), F.col("_weight") * level)).drop("_level")


def apportion(
    parties: DataFrame, keys: list[str], votes: str, seats: str, most: str, order: list[str]
) -> DataFrame:
    """Adds ``_seats``: the seats of each party by the highest quotients votes / (2 k + 1).

    ``seats`` is the house size, equal within ``keys``; no party gets more than ``most``; ties go
    to the smaller ``order``.  A party without votes gets none.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    n = F.count("*").over(group)
    share = F.col(votes) / F.sum(votes).over(group)
    bounds = parties.where(F.col(votes) > 0).withColumns({"_n": n, "_share": share})
    low = F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - F.col("_n") / 2) - 0.5) - 1)
    high = F.ceil(F.col("_share") * (F.col(seats) + F.col("_n")) + 1) + 1
    bounds = bounds.withColumn("_low", F.least(low.cast("long"), F.col(most)))
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    asked = bounds.withColumn(
        "_k",
        F.explode(
            F.when(
                F.least(high.cast("long"), F.col(most)) > F.col("_low"),
                F.sequence(F.col("_low"), F.least(high.cast("long"), F.col(most)) - 1),
            )
        ),
    )
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    place = F.row_number().over(group.orderBy(quotient.desc(), *order))
    won = (
        asked.withColumn("_place", place)
        .where(F.col("_place") <= F.col("_open"))
        .groupBy(*keys, *order)
        .agg(F.count("*").alias("_won"))
    )
    ids = [*keys, *order]
    sure = bounds.select(*ids, "_low")
    return (
        parties.join(sure, ids, "left")
        .join(won, ids, "left")
        .withColumn("_seats", F.coalesce("_low", F.lit(0)) + F.coalesce("_won", F.lit(0)))
        .drop("_low", "_won")
    )


def _blocks(words: Column, block: int) -> Column:
    return F.ceil(words / block).cast("long")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``KEY``, ``doc_id``, source columns, ``_size``, ``_words`` and
    ``_target`` of its source, and ``_taken``, the words the mixture takes from it."""
    sized = stage(_sized(docs, seed))
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("_rows") / shard_rows)).cast("long")
    sources = stage(targets(sized, weights).withColumn("_shards", shards_of))
    draw = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    placed = sized.join(sources.select(*_SOURCE, "_shards", "_words", "_target"), _SOURCE).withColumn(
        "_shard", F.pmod(draw, F.col("_shards"))
    )
    shards = (
        placed.groupBy(*_SOURCE, "_shard")
        .agg(F.sum("_size").alias("_shard_words"))
        .withColumn("_shard_blocks", _blocks(F.col("_shard_words"), block))
        .withColumn("_shard_most", MOST_REPEATS * F.col("_shard_blocks"))
    )
    most = shards.groupBy(*_SOURCE).agg(F.sum("_shard_most").alias("_most"))
    house = F.floor(F.col("_total") / block + 0.5)
    parties = sources.join(most, _SOURCE).withColumn("_house", house)
    quotas = apportion(parties, [], "_target", "_house", "_most", ["_rank"])
    per_shard = apportion(
        shards.join(quotas.select(*_SOURCE, "_seats").withColumnRenamed("_seats", "_quota"), _SOURCE),
        _SOURCE, "_shard_words", "_quota", "_shard_most", ["_shard"],
    )
    passes = F.when(F.col("_shard_blocks") > 0, F.floor(F.col("_seats") / F.col("_shard_blocks"))).otherwise(0)
    plan = per_shard.select(
        *_SOURCE,
        "_shard",
        passes.cast("long").alias("_passes"),
        ((F.col("_seats") - passes * F.col("_shard_blocks")) * block).cast("long").alias("_rest"),
    )
    line = Window.partitionBy(*_SOURCE, "_shard").orderBy("_order", "_doc", "_size", "_text_hash")
    until = F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rest = F.greatest(F.lit(0), F.least("_until", "_rest") - (F.col("_until") - F.col("_size")))
    return (
        placed.join(plan, [*_SOURCE, "_shard"])
        .withColumn("_until", until)
        .withColumn("_taken", (F.col("_passes") * F.col("_size") + rest).cast("long"))
        .select(*KEY, "doc_id", *_SOURCE, "_size", "_words", "_target", "_taken")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture: each row as often as its taken words fill it, rounded.

    A document's taken words are whole passes over it, but for the one document of a shard at which
    the last pass ends; that one is kept if at least half of it is taken.
    """
    copies = F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int")
    chosen = mixed(docs, **options).where(F.col("_taken") > 0).withColumn("_copies", copies)
    key = [*KEY, *_SOURCE]
    # Equal rows are told apart by a number, the same on both sides.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    picks = chosen.where("_copies > 0").select(*key, "_copies").withColumn("_nth", nth)
    own = with_key(docs).withColumns(
        {"_no_source": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}
    )
    return (
        own.withColumn("_nth", nth)
        .join(picks, [*key, "_nth"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
    )
