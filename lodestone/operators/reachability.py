"""Whether one node can reach another: an index that decides most pairs by comparing labels.

Strongly connected components are found by colours: every node takes the greatest node that reaches it, and what leads back to that node within its colour is a component.  The graph of components
has no cycles; a spanning forest of it is numbered so that a node's descendants in the forest are a range.  A pair is decided by

* its component, where both ends are in one;
* the forest, where the target is in the source's range;
* labels: the least and the greatest number that a component reaches, and its level (the longest way to it); a target outside these is not reached;
* a search for what is left, which gives up a branch as soon as the labels rule the target out and ends at the first node that has it in its range.

Building takes a few joins for each step of the longest of these searches, over nodes and edges, never over pairs; a question costs the rows that were asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.storage import written


def strong_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the greatest node of it) of every node with an edge.  ``edges``: ``src``, ``dst``."""
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    nodes = written(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "nodes")
    rest, found = links.filter("src <> dst"), None
    within = lambda rows, own: rows.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    while True:
        # what has no way in or no way out is a component of its own
        n = -1
        while True:
            rest = written(rest, "rest")
            m = rest.count()
            if m == n or not m:
                break
            n = m
            both = rest.select(F.col("src").alias("node")).distinct().join(rest.select(F.col("dst").alias("node")), "node", "left_semi")
            rest = within(rest, both)
        if not m:
            break
        colours = rest.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour"))
        colours = written(colours, "colours")
        front = colours
        while True:
            moved = front.join(rest, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_c"))
            front = written(moved.join(colours, "node").filter("_c > colour").select("node", F.col("_c").alias("colour")), "front")
            if front.isEmpty():
                break
            colours = written(colours.join(front.withColumnRenamed("colour", "_c"), "node", "left").select("node", F.coalesce("_c", "colour").alias("colour")), "colours")
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("_a")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("_b"))
        same = written(rest.join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst"), "same-colour")
        front = written(colours.filter("node = colour").select("node", F.col("colour").alias("component")), "components")
        own = front
        while True:
            back = front.join(same, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "component").distinct()
            front = written(back.join(own, "node", "left_anti"), "front")
            if front.isEmpty():
                break
            own = written(own.union(front), "components")
        found = own if found is None else found.union(own)
        gone = own.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return written(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")


@dataclass
class Index:
    """``components``: ``node``, ``component``; ``links``: ``src``, ``dst`` of components; ``labels``: ``component``, ``level``, ``place``, ``size`` (its range in the forest), ``low``, ``high``."""

    components: DataFrame
    links: DataFrame
    labels: DataFrame


def _levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``level``: the most steps that lead to a node of an acyclic graph."""
    held = written(nodes.select("node", F.lit(0).alias("level")), "levels")
    front, step = held, 0
    while True:
        step += 1
        front = written(front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "front")
        if front.isEmpty():
            return held
        held = written(held.join(front.withColumn("_l", F.lit(step)), "node", "left").select("node", F.coalesce("_l", "level").alias("level")), "levels")


def index(edges: DataFrame) -> Index:
    components = strong_components(edges)
    of = lambda c, name: components.select(F.col("node").alias(c), F.col("component").alias(name))
    links = edges.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    links = written(links, "component-links")
    nodes = components.select(F.col("component").alias("node")).distinct()
    levels = _levels(nodes, links)
    top = levels.agg(F.max("level")).first()[0] or 0
    # the forest: of the components one level above the least
    up = links.join(levels.select(F.col("node").alias("src"), F.col("level").alias("_a")), "src").join(levels.select(F.col("node").alias("dst"), F.col("level").alias("_b")), "dst").filter("_a + 1 = _b")
    parents = up.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    tree = written(levels.join(parents, "node", "left"), "forest")
    sizes = None
    for level in range(top, -1, -1):
        own = tree.filter(F.col("level") == level).select("node", "parent")
        if sizes is not None:
            below = last.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_s"))
            own = own.join(below, "node", "left")
        last = written(own.select("node", "parent", (F.lit(1).cast("long") + (F.coalesce("_s", F.lit(0)) if sizes is not None else 0)).alias("size")), "sizes")
        sizes = last if sizes is None else sizes.union(last)
    sizes = written(sizes, "all-sizes")
    # a range for each node within its parent's, behind those of its earlier siblings
    before = lambda *keys: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _roots(sizes.filter("parent IS NULL").select("node", "size"))
    every = placed
    for level in range(1, top + 1):
        kids = sizes.join(tree.filter(F.col("level") == level).select("node"), "node", "left_semi").withColumn("_b", before("parent"))
        placed = written(kids.join(placed.select(F.col("node").alias("parent"), F.col("place").alias("_p")), "parent").select("node", "size", (F.col("_p") + 1 + F.col("_b")).alias("place")), "places")
        every = every.union(placed)
    every = written(every, "all-places")
    # the least and the greatest place that a node reaches, from the last level up
    reached = None
    for level in range(top, -1, -1):
        own = every.join(tree.filter(F.col("level") == level).select("node"), "node", "left_semi").select("node", "place")
        if reached is not None:
            below = links.join(reached.select(F.col("node").alias("dst"), "low", "high"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
            own = own.join(below, "node", "left").select("node", F.least("place", "_l").alias("low"), F.greatest("place", "_h").alias("high"))
        else:
            own = own.select("node", F.col("place").alias("low"), F.col("place").alias("high"))
        part = written(own, "reached")
        reached = part if reached is None else reached.union(part)
    labels = tree.select("node", "level").join(every, "node").join(reached, "node").withColumnRenamed("node", "component")
    return Index(components, links, written(labels, "labels"))


def _roots(roots: DataFrame) -> DataFrame:
    """``node``, ``size``, ``place`` of the forest's roots: running sums by ranges of nodes, so that no task sorts all."""
    ranged = written(roots.withColumn("_range", F.pmod(F.xxhash64("node"), F.lit(max(1, roots.count() // 65_536)))), "roots")
    per = ranged.groupBy("_range").agg(F.sum("size").alias("_n"))
    starts = per.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("_range").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(ranged.withColumn("_in", inside).join(starts, "_range").select("node", "size", (F.col("_start") + F.col("_in")).alias("place")), "places")


def can_reach(pairs: DataFrame, found: Index) -> DataFrame:
    """``src``, ``dst``, ``reaches``, ``decided`` (``same``, ``component``, ``range``, ``label``, ``search``, ``unknown``) of the distinct pairs.

    A node reaches itself; one without edges reaches nothing else (``unknown``)."""
    asked = written(pairs.select("src", "dst").dropna().distinct(), "pairs")
    of = lambda c, name: found.components.select(F.col("node").alias(c), F.col("component").alias(name))
    side = lambda p: found.labels.select(*(F.col(c).alias(p + c) for c in found.labels.columns))
    both = asked.join(of("src", "a_component"), "src", "left").join(of("dst", "b_component"), "dst", "left").join(side("a_"), "a_component", "left").join(side("b_"), "b_component", "left")
    holds = "a_place <= b_place AND b_place < a_place + a_size"
    may = "a_low <= b_place AND b_place <= a_high AND a_level < b_level"
    decided = F.expr(f"CASE WHEN src = dst THEN 'same' WHEN a_component IS NULL OR b_component IS NULL THEN 'unknown' WHEN a_component = b_component THEN 'component' WHEN {holds} THEN 'range' WHEN NOT ({may}) THEN 'label' ELSE 'search' END")
    first = written(both.withColumn("decided", decided), "decided")
    goal = [c for c in first.columns if c.startswith("b_")]
    open_ = first.filter("decided = 'search'").select(F.col("a_component").alias("start"), F.col("a_component").alias("at"), *goal).distinct()
    front, seen, hits = written(open_, "front"), open_.select("start", "at", "b_component"), None
    while not front.isEmpty():
        moved = front.join(found.links, F.col("at") == F.col("src")).select("start", F.col("dst").alias("a_component"), *goal).distinct().join(side("a_"), "a_component")
        step = written(moved.filter(f"a_component = b_component OR {holds} OR ({may})").withColumn("hit", F.expr(f"a_component = b_component OR {holds}")), "step")
        now = step.filter("hit").select("start", "b_component").distinct()
        hits = now if hits is None else hits.union(now)
        more = step.filter("NOT hit").select("start", F.col("a_component").alias("at"), *goal).join(hits, ["start", "b_component"], "left_anti")
        front = written(more.join(seen, ["start", "at", "b_component"], "left_anti"), "front")
        seen = written(seen.union(front.select("start", "at", "b_component")), "seen")
    yes = F.col("decided").isin("same", "component", "range")
    if hits is None:
        return first.select("src", "dst", yes.alias("reaches"), "decided")
    met = hits.distinct().select(F.col("start").alias("a_component"), "b_component", F.lit(True).alias("_hit"))
    return first.join(met, ["a_component", "b_component"], "left").select("src", "dst", (yes | (F.col("decided") == "search") & F.coalesce("_hit", F.lit(False))).alias("reaches"), "decided")
