"""Connected components over an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _between(edges: DataFrame) -> DataFrame:
    """hi, lo: each edge between unlike nodes once, the larger node first."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()


def _followed(hooks: DataFrame) -> DataFrame:
    """hooks: hi, p (smaller). Each node with the end of its chain of hooks, by jumps that double what is jumped over."""
    while True:
        up = hooks.select(F.col("hi").alias("up"), F.col("p").alias("top"))
        jumped = written(hooks.join(up, hooks["p"] == up["up"], "left").select("hi", F.coalesce("top", "p").alias("p"), F.col("top").isNotNull().alias("moved")), "hooks")
        discard(hooks)
        hooks = jumped.select("hi", "p")
        hooks.written_to = jumped.written_to
        if not jumped.where("moved").limit(1).count():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of any ordered type. Returns c, label for every node of an edge; label is the smallest
    node of its component.

    In each round every node that has a smaller neighbour hooks to the smallest, chains of hooks are followed to their ends, and edges
    are drawn between these instead; those within an end, and repeated ones, go. At least half of the nodes that still have an edge hook in a round,
    so rounds are few and later ones small. Aggregations are combined before they are shuffled; what a round makes is written, so neither
    plans nor lost executors add up. Nothing but counts goes to the driver.
    """
    left = written(_between(edges), "edges")
    nodes = left.select(F.col("hi").alias("c")).unionByName(left.select(F.col("lo").alias("c"))).unionByName(edges.where("a = b").select(F.col("a").alias("c"))).distinct()
    labels = written(nodes.select("c", F.col("c").alias("label")), "labels")
    while left.limit(1).count():
        hooks = _followed(written(left.groupBy("hi").agg(F.min("lo").alias("p")), "hooks"))
        ends = lambda name: hooks.select(F.col("hi").alias(f"{name}_from"), F.col("p").alias(f"{name}_end"))
        moved = labels.join(ends("label"), F.col("label") == F.col("label_from"), "left")
        moved = written(moved.select("c", F.coalesce("label_end", "label").alias("label")), "labels")
        # the larger node of an edge always hooks, the smaller one may not
        drawn = left.join(ends("hi"), F.col("hi") == F.col("hi_from")).join(ends("lo"), F.col("lo") == F.col("lo_from"), "left")
        drawn = written(_between(drawn.select(F.col("hi_end").alias("a"), F.coalesce("lo_end", "lo").alias("b"))), "edges")
        discard(left, labels, hooks)
        left, labels = drawn, moved
    discard(left)
    return labels
