"""Connected components by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachflow.sources.scratch import written


def _roots(parent: DataFrame) -> DataFrame:
    """parent (node, up) with up replaced by the last node of its chain; every chain decreases, so it ends."""
    while True:
        above = parent.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
        parent = written(parent.join(above, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
        if parent.where("moved").isEmpty():
            return parent.select("node", "up")
        parent = parent.select("node", "up")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of an edge; edges have no direction.

    In each round every node hooks to its least neighbour if that is smaller; chains are shortened by pointer
    jumping, and edges are contracted to their roots. Every root that isn't the least of its neighbourhood vanishes,
    so at least half of a component's roots do, and the rounds are logarithmic in its size. Self-loops give a
    component of one; edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live = written(pairs.distinct())
    found = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("component"))
    while True:
        both = live.where("a <> b").select("a", "b").union(live.where("a <> b").select(F.col("b"), F.col("a")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).where("up < node"))
        if hooks.isEmpty():
            return found
        hooks = _roots(hooks)
        on = hooks.select(F.col("node").alias("h"), F.col("up").alias("h_up"))
        found = found.join(on, F.col("component") == F.col("h"), "left").select("node", F.coalesce("h_up", "component").alias("component"))
        found = written(found)
        moved = live.where("a <> b").join(on, F.col("a") == F.col("h"), "left").select(F.coalesce("h_up", "a").alias("a"), "b")
        moved = moved.join(on, F.col("b") == F.col("h"), "left").select("a", F.coalesce("h_up", "b").alias("b"))
        live = written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
