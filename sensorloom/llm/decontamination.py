"""Benchmark decontamination with a broadcast set of normalised n-grams.

A benchmark window is ``window`` consecutive words of an item; a shorter item is one window.  Every
occurrence of a window of L words covers a whole block of b = (L + 1) // 2 words of the document,
if the document is cut at multiples of b.  So the scan hashes only these disjoint blocks and looks
them up in the broadcast set of the benchmark's b-grams, one b per window length.  Documents with a
hit are then read window by window and joined to the windows' own words, which verifies each hit.

Only DataFrame expressions are used.  Defined cases: null or word-less texts have no words and are
never contaminated; null or word-less items have no window; an item without an id marks words but is
not counted; repeated rows are judged alike and each kept; further columns are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.tables import KEY, ascii_lower, bounded_broadcast, stage, with_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 13
#: Rows up to which a benchmark table is broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Normalised words; an empty array for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(parts, "")


def _steps(array: str, size: str, step: str) -> Column:
    """Start positions, from 0, of the pieces of ``size`` words at multiples of ``step``."""
    return F.expr(
        f"if(size({array}) >= {size}, sequence(0, size({array}) - {size}, {step}), "
        "cast(array() as array<int>))"
    )


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    cut = benchmark.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_w"))
    return cut.where(F.size("_w") > 0).withColumn("_len", F.least(F.size("_w"), F.lit(window)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_len``, ``_window`` (words joined by spaces) and ``_item`` of every window."""
    starts = _items(benchmark, window).withColumn("_at", F.explode(_steps("_w", "_len", "1")))
    return starts.select(
        "_len", F.expr("concat_ws(' ', slice(_w, _at + 1, _len))").alias("_window"), "_item"
    ).distinct()


def _anchors(benchmark: DataFrame, window: int) -> DataFrame:
    """Hashes of all b-grams of the items; b is part of the hash."""
    items = _items(benchmark, window).withColumn("_b", F.expr("(_len + 1) div 2").cast("int"))
    starts = items.withColumn("_at", F.explode(_steps("_w", "_b", "1")))
    return starts.select(
        F.expr("xxhash64(_b, slice(_w, _at + 1, _b))").alias("_hash"), F.lit(True).alias("_found")
    ).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Word counts of all documents, and the verified occurrences.

    The first has ``KEY``, ``doc_id``, ``_n_words``, ``_copies`` (equal rows); the second ``KEY``,
    ``_at`` (word position from 0), ``_len`` and ``_window``.
    """
    anchors = stage(_anchors(benchmark, window))
    lengths = sorted(r[0] for r in _items(benchmark, window).select("_len").distinct().collect())
    blocks = sorted({(n + 1) // 2 for n in lengths})

    def block_hashes(b: int) -> Column:
        return F.transform(
            _steps("_w", str(b), str(b)),
            lambda at: F.xxhash64(F.lit(b), F.slice(F.col("_w"), at + 1, F.lit(b))),
        )

    none = F.expr("cast(array() as array<bigint>)")
    cut = with_key(docs).select(*KEY, "doc_id", words(F.col("text")).alias("_w"))
    pieces = cut.select(
        *KEY,
        "doc_id",
        F.size("_w").alias("_n"),
        F.posexplode_outer(F.concat(none, *map(block_hashes, blocks))).alias("_at", "_hash"),
    )
    looked = pieces.join(bounded_broadcast(anchors, anchors.count(), BROADCAST_ROWS), "_hash", "left")
    counted = stage(
        looked.groupBy(*KEY).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("_n").cast("long").alias("_n_words"),
            F.sum((F.coalesce("_at", F.lit(0)) == 0).cast("long")).alias("_copies"),
            F.coalesce(F.max("_found"), F.lit(False)).alias("_found"),
        )
    )
    return counted.drop("_found"), _verified(docs, counted, benchmark, window, lengths)


def _verified(
    docs: DataFrame, counted: DataFrame, benchmark: DataFrame, window: int, lengths: list[int]
) -> DataFrame:
    wanted = counted.where("_found").select(*KEY)
    texts = with_key(docs.select("doc_id", "text")).join(wanted, KEY, "left_semi")
    cut = texts.select(*KEY, words(F.col("text")).alias("_w"))
    windows = stage(benchmark_windows(benchmark, window).select("_len", "_window").distinct())

    def occurrences(n: int) -> DataFrame:
        own = windows.where(F.col("_len") == n)
        texts = F.transform(
            _steps("_w", str(n), "1"),
            lambda at: F.concat_ws(" ", F.slice(F.col("_w"), at + 1, F.lit(n))),
        )
        spans = cut.select(*KEY, F.posexplode(texts).alias("_at", "_window"))
        return spans.join(bounded_broadcast(own, own.count(), BROADCAST_ROWS), "_window")

    found = [occurrences(n) for n in lengths]
    empty = "_doc bigint, _text_hash bigint, _at int, _len int, _window string"
    if not found:
        return docs.sparkSession.createDataFrame([], empty)
    hits = reduce(DataFrame.unionByName, found)
    return stage(hits.select(*KEY, "_at", "_len", "_window").distinct())


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document with ``KEY``, ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``."""
    counted, hits = scan(docs, benchmark, window)
    before = Window.partitionBy(*KEY).orderBy("_at", "_len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_at") + F.col("_len")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    spans = hits.select(*KEY, "_at", "_len").distinct()
    fresh = spans.withColumn("_fresh", F.greatest(F.lit(0), end - F.greatest("_at", reached)))
    covered = fresh.groupBy(*KEY).agg(F.sum("_fresh").alias("_hits"))
    owners = benchmark_windows(benchmark, window)
    # Windows can belong to many items, so only distinct windows of a document meet their items.
    found = hits.select(*KEY, "_len", "_window").distinct().join(owners, ["_len", "_window"])
    items = found.groupBy(*KEY).agg(F.collect_set(F.col("_item").cast("string")).alias("_items"))
    marks = covered.join(items, KEY)
    n_hit = F.coalesce("_hits", F.lit(0)).cast("long")
    ids = F.coalesce("_items", F.expr("cast(array() as array<string>)"))
    return (
        counted.join(marks, KEY, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(
            *KEY,
            "doc_id",
            F.col("_n_words").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", F.array_sort(ids)), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("_n_words"))).alias("contaminated"),
        )
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    bad = judged(docs, benchmark, window).where("contaminated").select(*KEY)
    return with_key(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, with the hit words and the separators before them cut out of ``text``."""
    _, hits = scan(docs, benchmark, window)
    covered = F.sequence(F.col("_at"), F.col("_at") + F.col("_len") - 1)
    spots = hits.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_set(covered))).alias("_hit"))
    # Each piece is a word with the separators before it; the last holds what follows the last word.
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).+?(?:{ANY_CASE_WORD}+|$)"), F.lit(0))
    marks = F.map_from_arrays(F.col("_hit"), F.transform("_hit", lambda p: F.lit(True)))
    cut = F.transform(
        "_pieces", lambda p, i: F.when(F.try_element_at(F.col("_marks"), i), F.lit("")).otherwise(p)
    )
    joined = with_key(docs).join(spots, KEY, "left").withColumns({"_pieces": pieces, "_marks": marks})
    text = F.when(F.col("_hit").isNull(), F.col("text")).otherwise(F.array_join(cut, ""))
    return joined.withColumn("text", text).select(*docs.columns)
