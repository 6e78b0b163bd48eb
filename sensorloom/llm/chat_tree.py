"""Chat formatting as a prefix tree.

Conversations that share their first turns share the nodes of a tree: a node stands for a prefix of
turns and holds the formatted text of its last turn once.  Runs of nodes that the same conversations
pass form a segment, so a path of segments is as long as its branchings, not as its turns.  Nodes
are emitted depth-first, parents before children: the sort key is the path of fixed-width segment
names and the turn number, so a distributed range sort gives the order, also where one first turn is
the root of a third of all conversations.  Each node has

* ``emit_start``/``emit_end``: its place in the emitted stream, in code points over all nodes;
* ``segment`` and ``turn_number`` (from 1), which order the nodes of a path;
* ``position``: the position id of its first character, the length of all ancestors;
* ``attention``: the stream intervals of its ancestors, root first, adjoining ones merged; a
  character attends to these and to the earlier characters of its own node;
* ``loss_start``/``loss_end``: the interval inside ``formatted`` that is trained on.

The template is ``<s>ROLE[INST]TEXT[/INST]</s>``.  In role and text a backslash is put after every
``<``, ``[`` and backslash, so that no control string of the template, or any of the strings
``</s>``, ``[/INST]`` and the like in a text, can be taken for one; ``unescaped`` undoes it.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), then role and
text; repeated rows are repeated turns; a null conv_id is one conversation; conversations with equal
turns share all nodes; empty tables give empty tables; further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.tables import stage

OPEN, SPLIT, CLOSE = "<s>", "[INST]", "[/INST]</s>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(SPLIT), escaped(text), F.lit(CLOSE))


def parsed(turn: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn."""
    body = F.substring(turn, len(OPEN) + 1, F.length(turn) - len(OPEN) - len(CLOSE))
    at = F.locate(SPLIT, body)
    return (
        unescaped(F.substring(body, F.lit(1), at - 1)),
        unescaped(F.substring(body, at + len(SPLIT), F.length(body))),
    )


@dataclass
class ChatTree:
    """``nodes``: one row per tree node; ``leaves``: ``conv_id`` and the ``path`` of its segments."""

    nodes: DataFrame
    leaves: DataFrame


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their number and the name of the prefix that ends with them.

    A name is made of two running exclusive-ors of hashes of the number, role and text of the turns,
    so a conversation of any length is one pass over its sorted rows.
    """
    turns = conversations.select(
        F.col("conv_id").isNull().alias("_no_id"),
        F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("_conv"),
        F.col("turn").alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy(*_CONVERSATION).orderBy("_turn", "role", "text")
    numbered = turns.withColumn("turn_number", F.row_number().over(order))
    so_far = Window.partitionBy(*_CONVERSATION).orderBy("turn_number").rowsBetween(Window.unboundedPreceding, 0)
    half = [F.bit_xor(F.xxhash64(F.lit(k), "turn_number", "role", "text")).over(so_far) for k in (1, 2)]
    name = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in half])
    return numbered.withColumn("node", name).drop("_turn")


_CONVERSATION = ["_no_id", "_conv"]


def build(conversations: DataFrame) -> ChatTree:
    turns = stage(_turns(conversations))
    # A name decides all other columns, so duplicates are dropped before and after the shuffle.
    nodes = turns.groupBy("node").agg(
        F.count("*").alias("_passing"), F.first("role").alias("role"), F.first("text").alias("text")
    )
    nodes = stage(nodes)
    steps = turns.select(*_CONVERSATION, "turn_number", "node").join(nodes.select("node", "_passing"), "node")
    along = Window.partitionBy(*_CONVERSATION).orderBy("turn_number")
    # Along a path the passing conversations can only get fewer, so equal numbers are equal sets.
    fewer = F.coalesce(F.col("_passing") != F.lag("_passing").over(along), F.lit(True)).cast("int")
    marked = steps.withColumn("_fewer", fewer).withColumn("_nth", F.sum("_fewer").over(along))
    runs = stage(
        marked.groupBy(*_CONVERSATION, "_nth").agg(
            F.min_by("node", "turn_number").alias("segment"),
            F.collect_list(F.struct("node", "turn_number")).alias("_nodes"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("_nth", "segment")))
    paths = stage(runs.groupBy(*_CONVERSATION).agg(F.transform(ordered, lambda x: x["segment"]).alias("path")))
    segments = (
        paths.select(F.posexplode("path").alias("_at", "segment"), "path")
        .select("segment", F.slice("path", 1, F.col("_at") + 1).alias("path"))
        .groupBy("segment")
        .agg(F.first("path").alias("path"))
    )
    # Each segment's nodes are listed once, however many conversations pass it.
    listed = runs.groupBy("segment").agg(F.first("_nodes").alias("_nodes"))
    places = segments.join(listed, "segment").select("segment", "path", F.explode("_nodes").alias("_n"))
    places = places.select("segment", "path", "_n.node", "_n.turn_number")
    whole = formatted(F.col("role"), F.col("text"))
    trained = F.col("role") == TRAINED_ROLE
    begin = F.length(escaped(F.col("role"))) + len(OPEN) + len(SPLIT)
    nodes = nodes.join(places, "node").select(
        "node", "segment", "turn_number", "path", "role",
        whole.alias("formatted"),
        F.length(whole).cast("long").alias("length"),
        F.when(trained, begin).cast("long").alias("loss_start"),
        F.when(trained, F.length(whole) - len(CLOSE)).cast("long").alias("loss_end"),
    ).withColumn("order_key", F.concat_ws("", "path"))
    leaves = paths.select(F.when(~F.col("_no_id"), F.col("_conv")).alias("conv_id"), "path")
    return ChatTree(_emitted(nodes), leaves)


def _emitted(nodes: DataFrame) -> DataFrame:
    """Depth-first places: offsets inside the sorted partitions plus those of the partitions."""
    order = ["order_key", "turn_number"]
    ranged = nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = stage(ranged.sortWithinPartitions(*order))
    # The places are made from lengths alone.  Blocks of paths that share a prefix keep a window
    # small: a block is a part and the first digits of the path.
    block = ["part", "_block"]
    light = ordered.select("node", "segment", "path", *order, "part", "length").withColumn(
        "_block", F.substring("order_key", 1, 2)
    )
    sums = light.groupBy(*block).agg(F.sum("length").alias("_sum"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(
        light.withColumn("_until", F.sum("length").over(inside))
        .join(bases, block)
        .select(
            "node",
            "segment",
            F.slice("path", 1, F.size("path") - 1).alias("_above"),
            (F.col("_base") + F.col("_until") - F.col("length")).alias("emit_start"),
            (F.col("_base") + F.col("_until")).alias("emit_end"),
        )
    )
    spans = placed.groupBy("segment").agg(
        F.min("emit_start").alias("_start"), F.max("emit_end").alias("_end"), F.first("_above").alias("_above")
    )
    spans = stage(spans)
    links = spans.select("segment", F.explode("_above").alias("_ancestor"))
    ancestors = links.join(spans.select(F.col("segment").alias("_ancestor"), "_start", "_end"), "_ancestor")
    above = ancestors.groupBy("segment").agg(
        F.sum(F.col("_end") - F.col("_start")).alias("_before"),
        F.array_sort(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("_spans"),
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    own = F.struct(F.col("_start").alias("start"), F.col("emit_start").alias("end"))
    spans = spans.select("segment", "_start").join(above, "segment", "left")
    merged = F.expr(
        """aggregate(_all, cast(array() as array<struct<start: bigint, end: bigint>>), (all, s) ->
             if(size(all) > 0 and try_element_at(all, -1).end = s.start,
                array_append(slice(all, 1, size(all) - 1),
                             named_struct('start', try_element_at(all, -1).start, 'end', s.end)),
                array_append(all, s)))"""
    )
    within = F.when(F.col("emit_start") > F.col("_start"), F.array(own)).otherwise(none)
    located = (
        placed.drop("_above")
        .join(spans, "segment")
        .withColumn("_all", F.concat(F.coalesce("_spans", none), within))
        .select(
            "node", "emit_start", "emit_end",
            (F.coalesce("_before", F.lit(0)) + F.col("emit_start") - F.col("_start")).alias("position"),
            merged.alias("attention"),
        )
    )
    return ordered.join(located, "node").drop("part", "order_key", "path")


def read_back(tree: ChatTree) -> DataFrame:
    """One row per conversation, from the emitted nodes: its turns and what the loss mask covers."""
    nodes = stage(tree.nodes)
    steps = tree.leaves.select(
        F.col("conv_id").isNull().alias("_no_id"),
        F.coalesce("conv_id", F.lit(0)).alias("_conv"),
        F.explode("path").alias("segment"),
    )
    role, text = parsed(F.col("formatted"))
    under = F.substring(
        F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")
    )
    cut = nodes.select(
        "segment",
        F.col("turn_number").alias("_at"),
        F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("_turn"),
        F.coalesce(unescaped(under), F.lit("")).alias("_loss"),
        "length",
    )
    whole = (
        steps.join(cut, "segment")
        .groupBy(*_CONVERSATION)
        .agg(
            F.array_sort(F.collect_list(F.struct("_at", "_turn", "_loss"))).alias("_all"),
            F.sum("length").alias("formatted_chars"),
        )
    )
    loss = F.concat_ws("", F.col("_all._loss"))
    return whole.select(
        F.when(~F.col("_no_id"), F.col("_conv")).alias("conv_id"),
        F.size("_all").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.col("_all._turn")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
