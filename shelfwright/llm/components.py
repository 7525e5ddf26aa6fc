"""Connected components over an edge table, without ever gathering a group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long edges -> ``(node, component)`` with the smallest node of each component.

    Every round hooks each node to its smallest neighbour, jumps once to that one's own hook, and contracts the
    edges to the new labels; at least half of the nodes with edges vanish per round. Minima are pre-aggregated before
    the shuffle, and joins on a hub are ordinary sort-merge joins that adaptive execution can split.
    Self-loops and repeated edges are harmless; nulls are dropped; an empty table gives an empty table.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        hook = materialize(hook, "hook")
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = materialize(hook.join(up, "parent").select("node", F.col("grand").alias("component")), "labels")
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        ahead = edges.join(to_a, "a").join(to_b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct()
        ahead = materialize(ahead, "edges")
        discard(hook, edges)
        edges = ahead
        if total is None:
            total = step
        else:
            renamed = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            moved = materialize(total.join(renamed, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            discard(total, step)
            total = moved
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(edges)
    return total

