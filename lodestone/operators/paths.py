"""Paths with their nodes: the first of them in order, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import WORD, nearest_origin, reach
from lodestone.operators.storage import written


def _first_pairs(links: DataFrame, sources: DataFrame, sinks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pairs (``origin``, ``sink``, ``dist``) of a source and a sink that it reaches, in order; sources are searched a word at a time until there are enough."""
    spark = links.sparkSession
    asked = written(sources.select("node").dropna().distinct(), "sources")
    ends = written(sinks.select(F.col("node").alias("sink")).dropna().distinct(), "sinks")
    found, n, after = None, 0, None
    while n < most:
        rest = asked if after is None else asked.filter(F.col("node") > F.lit(after))
        block = [r.node for r in rest.orderBy("node").limit(WORD).collect()]
        if not block:
            break
        after = block[-1]
        seeds = spark.createDataFrame([(x, x) for x in block], "origin {0}, node {0}".format(asked.schema["node"].dataType.simpleString()))
        met = reach(links, seeds).join(ends, F.col("node") == F.col("sink"), "left_semi").select("origin", F.col("node").alias("sink"), "dist")
        new = written(met.orderBy("origin", "sink").limit(most - n), "pairs")
        found, n = new if found is None else found.union(new), n + new.count()
    return found if found is not None else ends.select(F.col("sink").alias("origin"), "sink", F.lit(0).alias("dist")).limit(0)


def shortest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` shortest paths of sources to sinks, by source, sink and nodes: ``origin``, ``sink``, ``path``, ``n``, the number of shortest paths of the pair (``most`` stands for more).

    Pairs come first: at most ``most`` of them are looked at.  From their sinks back the number of ways to the sink is counted at each node that lies on a shortest path, up to ``most``.  Then paths are
    made from the sources on; each carries how many it may become, which it deals out to the next nodes in their order by their counts, so every row is the beginning of a path that is returned.
    ``edges``: ``src``, ``dst``; ``sources``, ``sinks``: ``node``."""
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    pairs = written(_first_pairs(links, sources, sinks, most), "first-pairs")
    # distances from the sources, for these sources only
    far = written(reach(links, pairs.select("origin", F.col("origin").alias("node")).distinct()).select("origin", "node", F.col("dist").alias("_at")), "distances")
    one = pairs.select("origin", "sink", F.col("sink").alias("node"), "dist", F.lit(1).cast("long").alias("n"))
    level, every, left = written(one, "ways"), None, pairs.agg(F.max("dist")).first()[0] or 0
    every = level
    for _ in range(left):
        # nodes one step nearer to the source on some shortest path of the pair; a pair's levels go down together
        before = level.filter("dist > 0").join(links, F.col("node") == F.col("dst")).select("origin", "sink", F.col("src").alias("node"), (F.col("dist") - 1).alias("dist"), "n")
        before = before.join(far, ["origin", "node"]).filter("_at = dist").groupBy("origin", "sink", "node", "dist").agg(F.least(F.sum("n"), F.lit(most)).alias("n"))
        level = written(before, "ways")
        every = every.union(level)
    every = written(every, "all-ways")
    starts = every.filter("dist = 0 AND origin = node").select("origin", "sink", "node", "n")
    over = Window.orderBy("origin", "sink").rowsBetween(Window.unboundedPreceding, -1)  # pairs number ``most`` at most
    take = F.least(F.col("n"), F.lit(most) - F.coalesce(F.sum("n").over(over), F.lit(0)))
    front = starts.select("origin", "sink", "node", F.array("node").alias("path"), "n", take.alias("take"), F.lit(0).alias("dist")).filter("take > 0")
    front, done = written(front, "paths"), None
    for _ in range(left + 1):
        ended = front.filter("node = sink")
        done = ended if done is None else done.union(ended)
        ways = every.select("origin", "sink", F.col("node").alias("dst"), F.col("dist").alias("_d"), F.col("n").alias("_n"))
        onward = front.filter("node <> sink").join(links, F.col("node") == F.col("src")).join(ways, ["origin", "sink", "dst"]).filter("_d = dist + 1")
        earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("origin", "sink", "path").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = onward.withColumn("_take", F.least(F.col("_n"), F.col("take") - earlier)).filter("_take > 0")
        front = written(onward.select("origin", "sink", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), "n", F.col("_take").alias("take"), (F.col("dist") + 1).alias("dist")), "paths")
        if front.isEmpty():
            break
    return done.select("origin", "sink", "path", "n")


def _chains(links: DataFrame, near: DataFrame, asked: DataFrame) -> DataFrame:
    """``node``, ``path`` from each asked node's nearest origin: of the predecessors one step nearer to the same origin the least."""
    step = links.join(near.select(F.col("node").alias("src"), (F.col("dist") + 1).alias("_d"), F.col("origin").alias("_o")), "src")
    step = step.join(near.select(F.col("node").alias("dst"), "dist", "origin"), "dst").filter("_d = dist AND _o = origin")
    parents = written(step.groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("parent")), "parents")
    front = written(asked.join(near, "node").select("node", F.col("node").alias("at"), F.array("node").alias("path"), F.col("dist").alias("left")), "chains")
    done = None
    while True:
        ended = front.filter("left = 0").select("node", "path")
        done = ended if done is None else done.union(ended)
        more = front.filter("left > 0").join(parents, "at")
        front = written(more.select("node", F.col("parent").alias("at"), F.concat(F.array("parent"), "path").alias("path"), (F.col("left") - 1).alias("left")), "chains")
        if front.isEmpty():
            return done


def entry_paths(edges: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``node``, ``kind`` (``entry``, ``root``), ``path`` for each asked node: from the nearest entry, the least of equally near ones; where none reaches it, from the nearest node without predecessors that does.

    ``edges``: ``src``, ``dst``; ``entries``, ``asked``: ``node``.  Nodes that only cycles lead to have no path.  Searches are one row a node, and only asked nodes are walked back."""
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    wanted = written(asked.select("node").dropna().distinct(), "asked")
    seeds = lambda rows: rows.select("node").dropna().distinct().select(F.col("node").alias("origin"), "node")
    near = nearest_origin(links, seeds(entries))
    found = written(_chains(links, near, wanted).withColumn("kind", F.lit("entry")), "entry-paths")
    rest = written(wanted.join(found, "node", "left_anti"), "unreached")
    if rest.isEmpty():
        return found.select("node", "kind", "path")
    roots = links.select(F.col("src").alias("node")).distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    fallback = _chains(links, nearest_origin(links, seeds(roots)), rest).filter("size(path) > 1").withColumn("kind", F.lit("root"))
    return found.unionByName(fallback).select("node", "kind", "path")
