"""Dominators, dominance frontiers and the places of phi nodes, for the control flow of all functions at once.

A node is dominated by what cannot be left out on the way to it: for each node of a function a search from its entry that keeps clear of it, all of them together as rows of (function, node left out, node
reached).  So the work is the square of a function's statements, summed over functions, and each round is an equi-join on the edges' keys; functions don't meet in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import written

FOLD = 6


def dominators(edges: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key``, ``node``, ``dominator`` (itself among them) of the nodes that the entry reaches.  ``edges``: ``key``, ``src``, ``dst``; ``entries``: ``key``, ``node``, one of each function."""
    links = written(edges.select(key, "src", "dst").dropna().distinct(), "links")
    first = entries.select(key, F.col("node").alias("entry")).dropna().distinct()
    nodes = written(links.select(key, F.col("src").alias("node")).union(links.select(key, "dst")).union(first).distinct(), "nodes")
    # null: nothing is left out; an entry left out leaves nothing
    out = nodes.select(key, F.col("node").alias("out")).union(nodes.select(key, F.lit(None).cast(nodes.schema["node"].dataType)).distinct())
    start = out.join(first, key).filter("out IS NULL OR out <> entry").select(key, "out", F.col("entry").alias("node"))
    front = written(start.withColumn("whole", F.col("out").isNull()).select(key, F.coalesce("out", "node").alias("out"), "whole", "node"), "clear")
    seen, held, columns = front, 1, [key, "out", "whole", "node"]
    while not front.isEmpty():
        moved = front.withColumnRenamed("node", "src").join(links, [key, "src"]).filter("whole OR dst <> out").select(key, "out", "whole", F.col("dst").alias("node")).distinct()
        front = written(moved.join(seen, columns, "left_anti"), "clear")
        seen, held = seen.union(front), held + 1
        if held >= FOLD:
            seen, held = written(seen, "all-clear"), 1
    reached = seen.filter("whole").select(key, "node").distinct()
    clear = seen.filter("NOT whole").select(key, F.col("out").alias("dominator"), "node")
    every = reached.join(nodes.withColumnRenamed("node", "dominator"), key)
    return written(every.join(clear, [key, "dominator", "node"], "left_anti").select(key, "node", "dominator"), "dominators")


def immediate(dominated: DataFrame, key: str) -> DataFrame:
    """``key``, ``node``, ``parent``: the nearest dominator besides itself, the one that most others dominate; entries have none."""
    depth = dominated.groupBy(key, F.col("node").alias("dominator")).agg(F.count(F.lit(1)).alias("_depth"))
    return dominated.filter("node <> dominator").join(depth, [key, "dominator"]).groupBy(key, "node").agg(F.max_by("dominator", "_depth").alias("parent"))


def frontiers(edges: DataFrame, dominated: DataFrame, key: str) -> DataFrame:
    """``key``, ``node``, ``frontier``: where a node's dominance ends, which is behind an edge from what it dominates to what it does not, itself possibly among them."""
    before = edges.select(key, "src", F.col("dst").alias("frontier")).distinct().join(dominated.select(key, F.col("node").alias("src"), F.col("dominator").alias("node")), [key, "src"])
    strict = dominated.filter("node <> dominator").select(key, F.col("node").alias("frontier"), F.col("dominator").alias("node"))
    return before.select(key, "node", "frontier").distinct().join(strict, [key, "node", "frontier"], "left_anti")


def phi_nodes(edges: DataFrame, entries: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """``key``, ``variable``, ``node`` of phi nodes: the iterated frontiers of a variable's definitions (``key``, ``variable``, ``at``); a phi is a definition of its own.

    Definitions that the entry does not reach count for nothing."""
    dominated = dominators(edges, entries, key)
    ends = written(frontiers(edges, dominated, key), "frontiers")
    alive = dominated.select(key, "node").distinct()
    front = written(definitions.select(key, "variable", F.col("at").alias("node")).distinct().join(alive, [key, "node"], "left_semi"), "phis")
    found = None
    while True:
        met = front.join(ends, [key, "node"]).select(key, "variable", F.col("frontier").alias("node")).distinct()
        front = written(met if found is None else met.join(found, [key, "variable", "node"], "left_anti"), "phis")
        if front.isEmpty():
            return front if found is None else found
        found = front if found is None else written(found.union(front), "all-phis")
