"""Connected components of a graph that no machine has to hold.

Rounds of contraction: every node takes the smallest node, by a hash that changes
with the round, within two steps; edges are then drawn between what was taken. The
number of nodes falls by a factor in each round, for long chains and for stars alike.

Edges meet what their ends took by a join on the end. Nodes with over a thousandth of all
edge ends, of which there are at most a thousand, are hubs: what these took is broadcast, so no
hub's edges land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.sources.tables import checkpoint

#: The share of all edge ends that makes a hub is one over this, so there are no more hubs than this.
HUBS = 1000


def _met(edges: DataFrame, end: str, taken: DataFrame, value: str, hubs: DataFrame | None) -> DataFrame:
    """Edges with what the node at ``end`` took, as ``value``; ``taken`` has ``node, head`` for each node."""
    told = taken.select(F.col("node").alias(end), F.col("head").alias(value))
    if hubs is None:
        return edges.join(told, end)
    few = F.broadcast(told.join(F.broadcast(hubs.withColumnRenamed("node", end)), end, "left_semi"))
    rest = edges.join(F.broadcast(hubs.withColumnRenamed("node", end)), end, "left_anti").join(told, end)
    return edges.join(few, end).unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges ``src``, ``dst``."""
    live = checkpoint(edges.where("src <> dst").select("src", "dst").distinct())
    labels = None
    turn = 0
    while size := live.count():
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = both.groupBy("src").agg(F.min(ranked("dst")).alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("src").alias("node"), F.least("m", ranked("src")).alias("head"), "n")
        near = checkpoint(near)
        hubs = near.where(F.col("n") > max(64, 2 * size // HUBS)).select("node")
        hubs = None if hubs.isEmpty() else hubs
        far = _met(both, "dst", near, "m", hubs).groupBy("src").agg(F.min("m").alias("far"))
        hop = checkpoint(near.join(far, F.col("node") == F.col("src")).select("node", F.least("head", "far")["v"].alias("head")))
        if labels is None:
            labels = hop
        else:
            step = hop.select(F.col("node").alias("old"), F.col("head").alias("new"))
            labels = checkpoint(labels.join(step, F.col("head") == F.col("old"), "left").select("node", F.coalesce("new", "head").alias("head")))
        drawn = _met(_met(live, "src", hop, "a", hubs), "dst", hop, "b", hubs)
        live = checkpoint(drawn.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        turn += 1
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    least = labels.groupBy("head").agg(F.min("node").alias("component"))
    return labels.join(least, "head").select("node", "component")
