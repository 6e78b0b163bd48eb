"""Connected components of a link table, by alternating large and small stars.

Every round is a pair of aggregates and joins over the links that are left; the tables stay
distributed and are written between rounds.  A node with very many neighbours is only the key of a
partial minimum, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import stage


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest of them and itself.

    Large star (``both_ways``): larger neighbours only, seen from both ends; small star: the node
    and its smaller neighbours.
    """
    if both_ways:
        seen = edges.select(F.col("_a").alias("_x"), F.col("_b").alias("_y")).unionByName(
            edges.select(F.col("_b").alias("_x"), F.col("_a").alias("_y"))
        )
    else:
        seen = edges.select(F.greatest("_a", "_b").alias("_x"), F.least("_a", "_b").alias("_y"))
    least = seen.groupBy("_x").agg(F.least(F.min("_y"), F.first("_x")).alias("_m"))
    linked = seen.join(least, "_x")
    if both_ways:
        out = linked.where("_y > _x").select(F.col("_y").alias("_a"), F.col("_m").alias("_b"))
    else:
        out = linked.select(F.col("_y").alias("_a"), F.col("_m").alias("_b")).unionByName(
            least.select(F.col("_x").alias("_a"), F.col("_m").alias("_b"))
        )
    return out.where("_a != _b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``_node`` and ``_component``, the smallest node reachable, for all linked nodes.

    The columns ``_a`` and ``_b`` are the ends of the links.  Self links and repeats do no harm.
    """
    edges = stage(links.select("_a", "_b").where("_a != _b").distinct())
    last = None
    while True:
        edges = stage(_star(_star(edges, True), False))
        # The same hash twice means that no link has moved.
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("_a", "_b"))).first()
        if now == last or not now[0]:
            break
        last = now
    return edges.groupBy(F.col("_a").alias("_node")).agg(F.min("_b").alias("_component")).unionByName(
        edges.select(F.col("_b").alias("_node"), F.col("_b").alias("_component")).distinct()
    )
