"""Graph queries: islands are searched in a task each (``islands``), what is larger by frontier joins.

Searches from many origins at once carry sets of origins as bits: a row is (node, word, 64 origins), so a step joins one row for 64 pairs of
(origin, node), and what reaches a node by many edges is combined by ``bit_or`` before it is shuffled.  Steps are written, so a lost executor costs one
step; a step reads the frontier, the edges and one table of what was seen.  Pairs are only written out at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import islands
from lodestone.operators.storage import written

WORD = 64
#: Ranges of origins that get their numbers each in a task.
RANGES = 2000
#: Categories of sinks are kinds of weaknesses; a search carries each.
MOST_CATEGORIES = 64


def _numbered(seeds: DataFrame) -> DataFrame:
    """``origin``, ``word``, ``bit``: places for the distinct origins, about 64 to a word; near origins share a word, as they reach the same nodes.  No task sorts more than a range of them."""
    origins = seeds.select("origin").distinct()
    words = max(1, -(-origins.count() // WORD))
    dealt = written(origins.repartitionByRange(min(words, RANGES), "origin").withColumn("_bucket", F.spark_partition_id()), "ranges")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("origin")) - 1
    return dealt.withColumn("_nth", place).select("origin", F.struct("_bucket", F.floor(F.col("_nth") / WORD).alias("_more")).alias("word"), (F.col("_nth") % WORD).alias("bit"))


def _levels(links: DataFrame, numbers: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """``node``, ``word``, ``bits``, ``dist``: the origins that reach a node first after so many steps."""
    start = seeds.join(numbers, "origin").groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"))
    front = written(start.withColumn("dist", F.lit(0)), "front")
    found, seen, step = front, front.select("node", "word", "bits"), 0
    while depth is None or step < depth:
        step += 1
        moved = front.join(links, front["node"] == links["src"]).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("moved"))
        known = moved.join(seen, ["node", "word"], "left")
        new = F.expr("moved & ~coalesce(bits, 0L)")
        front = written(known.select("node", "word", new.alias("bits"), F.lit(step).alias("dist")).filter("bits <> 0"), "front")
        if front.isEmpty():
            break
        found = found.union(front)
        seen = written(seen.union(front.select("node", "word", "bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "seen")
    return found


def _pairs(levels: DataFrame, numbers: DataFrame) -> DataFrame:
    """``origin``, ``node``, ``dist`` of every bit that is set.  A word's origins are joined as one row, so no pair is shuffled."""
    own = numbers.groupBy("word").agg(F.collect_list(F.struct("bit", "origin")).alias("own"))
    met = F.explode(F.expr("filter(own, o -> getbit(bits, cast(o.bit AS int)) = 1)")).alias("o")
    return levels.join(own, "word").select("node", "dist", met).select("o.origin", "node", "dist")


def _far(links: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """``reach`` by frontier joins."""
    numbers = written(_numbered(seeds), "origins")
    return _pairs(_levels(links, numbers, seeds, depth), numbers)


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, targets: DataFrame | None = None, most: int = islands.LINKS) -> DataFrame:
    """``origin``, ``node``, ``dist``: what each seed reaches in at most ``depth`` steps (None: all), itself at 0.

    ``edges``: ``src``, ``dst``; ``seeds``: ``origin``, ``node``; ``targets``: ``node``, those that are asked for (None: all).  Null ends and seeds take no part.  The rows number what is asked for, origins
    times nodes at most.  Islands of at most ``most`` edges are searched whole where there are more origins than fit a word, but few beside the edges: where nearly every node is one, as in a hierarchy, sets
    are small and steps cheap."""
    links = written(edges.select("src", "dst").distinct(), "links")
    seeds = written(seeds.select("origin", "node").dropna().distinct(), "seeds")
    wanted = None if targets is None else targets.select("node").dropna().distinct()
    asked = lambda rows: rows if wanted is None else rows.join(wanted, "node", "left_semi").select("origin", "node", "dist")
    if not islands.fits(links, seeds) or not WORD < seeds.select("origin").distinct().count() <= links.count() // 8:
        return asked(_far(links, seeds, depth))
    found, rest = islands.search(links.dropna(), seeds, islands.Search(depth, targets=wanted is not None), targets=wanted, most=most)
    return found if rest is None else found.union(asked(_far(*rest, depth)))


def shortest_tree(edges: DataFrame, seeds: DataFrame, depth: int | None = None, most: int = islands.LINKS) -> DataFrame:
    """``reach`` with ``parent``, the least predecessor on a shortest path."""
    links = written(edges.select("src", "dst").distinct(), "links")
    seeds = written(seeds.select("origin", "node").dropna().distinct(), "seeds")
    far = lambda links, seeds: shortest_parents(links, written(_far(links, seeds, depth), "reach"))
    if not islands.fits(links, seeds):
        return far(links, seeds)
    found, rest = islands.search(links.dropna(), seeds, islands.Search(depth, parents=True), most=most)
    return found if rest is None else found.unionByName(far(*rest))


def reach_within(edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """As ``reach`` with a depth, and the gap: ``origin``, ``node`` of what was found in the last step and leads on to nodes that were not found."""
    links = written(edges.select("src", "dst").distinct(), "links")
    found = written(reach(links, seeds, depth), "reach")
    last = found.filter(F.col("dist") == depth).select("origin", "node")
    onward = last.join(links, last["node"] == links["src"]).select("origin", "node", "dst")
    open_ = onward.join(found.select("origin", F.col("node").alias("dst")), ["origin", "dst"], "left_anti")
    return found, open_.select("origin", "node").distinct()


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, most: int = islands.LINKS) -> DataFrame:
    """``origin``, ``node``, ``category``, ``sanitized``, ``dist``: the best flow of each source to each sink, on paths of any length.

    ``sources``: ``origin``, ``node``; ``sinks``: ``node``, ``category``; ``sanitizers``: ``node``, ``category`` (``*``: all), which stop flows that come in at the node for sinks of that
    category.  A flow is sanitized only if every path to the sink is; of equal ones the shortest counts.  Categories are few; the search runs over (node, category,
    met a sanitizer) at once."""
    kinds = sorted(r["category"] for r in sinks.select("category").dropna().distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(kinds) > MOST_CATEGORIES:
        raise ValueError(f"sinks have {MOST_CATEGORIES} categories at most")
    if not kinds:
        none = sources.select("origin", "node").limit(0)
        return none.select("*", F.lit("").alias("category"), F.lit(False).alias("sanitized"), F.lit(0).alias("dist"))
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    seeds = written(sources.select("origin", "node").dropna().distinct(), "seeds")
    if not islands.fits(links, seeds):
        return _far_flows(links, seeds, sinks, sanitizers, kinds)
    every = F.array(*(F.lit(k) for k in range(len(kinds))))
    place = F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(kinds) for x in (c, k))), F.col("category"))
    stops = sanitizers.select("node", F.explode(F.when(F.col("category") == "*", every).otherwise(F.array(place))).alias("category")).dropna().distinct()
    ends = sinks.select("node", place.alias("category")).dropna().distinct()
    found, rest = islands.search(links, seeds, islands.Search(kinds=kinds, targets=True), stops, ends, most)
    found = found.select("origin", "node", "category", F.col("clean").alias("sanitized"), "dist")
    return found if rest is None else found.union(_far_flows(*rest, sinks, sanitizers, kinds))


def _far_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, kinds: list[str]) -> DataFrame:
    """``flows`` by frontier joins."""
    every = F.array(*map(F.lit, kinds))
    stops = sanitizers.select(F.col("node").alias("dst"), F.explode(F.when(F.col("category") == "*", every).otherwise(F.array("category"))).alias("_c"), F.lit(True).alias("_stop")).distinct()
    wide = edges.select("src", "dst").distinct().select("src", "dst", F.explode(every).alias("_c")).join(stops, ["dst", "_c"], "left")
    twice = wide.select("src", "dst", "_c", F.coalesce("_stop", F.lit(False)).alias("_stop"), F.explode(F.array(F.lit(False), F.lit(True))).alias("_clean"))
    at = lambda node, clean: F.struct(F.col(node).alias("node"), F.col("_c").alias("category"), clean.alias("clean"))
    links = twice.select(at("src", F.col("_clean")).alias("src"), at("dst", F.col("_clean") | F.col("_stop")).alias("dst"))
    seeds = sources.select("origin", "node", F.explode(every).alias("_c")).select("origin", at("node", F.lit(False)).alias("node"))
    found = _far(written(links.distinct(), "links"), written(seeds, "seeds"), None).select("origin", "node.node", "node.category", "node.clean", "dist").join(sinks.select("node", "category").distinct(), ["node", "category"])
    best = found.groupBy("origin", "node", "category").agg(F.min(F.struct("clean", "dist")).alias("b"))
    return best.select("origin", "node", "category", F.col("b.clean").alias("sanitized"), "b.dist")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes of ``nodes`` (column ``node``)."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_parents(edges: DataFrame, found: DataFrame) -> DataFrame:
    """For each reached node the least predecessor on a shortest path from its origin: ``origin``, ``node``, ``dist``, ``parent``."""
    links = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).distinct()
    before = found.select("origin", F.col("node").alias("parent"), (F.col("dist") + 1).alias("dist"))
    step = before.join(links, "parent").groupBy("origin", "node", "dist").agg(F.min("parent").alias("parent"))
    return found.join(step, ["origin", "node", "dist"], "left")


def nearest_origin(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``, ``dist``, ``origin``: the nearest seed of each node that any seed reaches, the least one of equally near ones.

    One row a node: all nodes of a level are found together, and the least origin of a node is the least of its predecessors' a level before."""
    links = written(edges.select("src", "dst").distinct(), "links")
    least = F.min("origin").alias("origin")
    seen = written(seeds.groupBy("node").agg(least).select("node", F.lit(0).alias("dist"), "origin"), "nearest")
    front, step = seen, 0
    while True:
        step += 1
        new = front.join(links, front["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(least)
        new = written(new.join(seen, "node", "left_anti").select("node", F.lit(step).alias("dist"), "origin"), "front")
        if new.isEmpty():
            return seen
        seen, front = seen.union(new), new


def propagate(edges: DataFrame, seeds: DataFrame, blocked: DataFrame, depth: int | None = None, most: int = islands.LINKS) -> DataFrame:
    """Facts that flow along edges: ``origin``, ``node``, ``clean`` (whether every such flow has passed a blocked node), ``dist`` of the best flow.

    At most ``depth`` steps; None: until nothing is new.  With a depth a node is clean by the flows of that length only.
    Unsanitised flows win over sanitised ones, then shorter ones.  ``blocked``: ``node``.  It is a search over nodes that stand twice, for flows
    that have met a blocked node and for those that have not."""
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    seeds = written(seeds.select("origin", "node").dropna().distinct(), "seeds")
    if not islands.fits(links, seeds):
        return _far_propagate(links, seeds, blocked, depth)
    stops = blocked.select("node", F.lit(0).alias("category")).dropna().distinct()
    found, rest = islands.search(links, seeds, islands.Search(depth, kinds=[""]), stops, most=most)
    found = found.select("origin", "node", "clean", "dist")
    return found if rest is None else found.union(_far_propagate(*rest, blocked, depth))


def _far_propagate(edges: DataFrame, seeds: DataFrame, blocked: DataFrame, depth: int | None) -> DataFrame:
    """``propagate`` by frontier joins."""
    stop = blocked.select(F.col("node").alias("dst"), F.lit(True).alias("_stop")).dropna().distinct()
    marked = edges.select("src", "dst").distinct().join(stop, "dst", "left").withColumn("_stop", F.coalesce("_stop", F.lit(False)))
    at = lambda node, clean: F.struct(F.col(node).alias("node"), clean.alias("clean"))
    twice = marked.select(F.col("src"), "dst", "_stop", F.explode(F.array(F.lit(False), F.lit(True))).alias("_clean"))
    twice = twice.select(at("src", F.col("_clean")).alias("src"), at("dst", F.col("_clean") | F.col("_stop")).alias("dst"))
    found = _far(written(twice.distinct(), "links"), written(seeds.select("origin", at("node", F.lit(False)).alias("node")), "seeds"), depth)
    best = found.groupBy("origin", F.col("node.node").alias("node")).agg(F.min(F.struct("node.clean", "dist")).alias("b"))
    return best.select("origin", "node", "b.clean", "b.dist")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node of its connected component, for every node with an edge.  ``edges``: ``src``, ``dst``, in either direction.

    Alternating stars: in a round a node's larger neighbours, then its smaller ones, are tied to the least of all.  The rounds number the logarithm of
    a component's size; each is one aggregate and one equi-join over as many edges as there were, and is written."""
    down = lambda e: e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).dropna()
    alone = ends.filter("u = v").select(F.col("u").alias("node")).distinct()
    held, state = written(down(ends), "stars"), None
    while True:
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = down(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        held = written(down(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)), "stars")
    roots = held.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    found = held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    return found.union(alone.join(found, "node", "left_anti").withColumn("root", F.col("node")))
