"""Control flow and dataflow inside functions, and paths that keep call contexts, as joins and bounded fixed points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import nearest_origin, reach
from lodestone.operators.storage import written


def control_edges(statements: DataFrame, key: str, line: str, kind: Column) -> DataFrame:
    """Edges between the statements of a function, by line: ``src``, ``dst``, ``edge``.

    A statement leads to the next one; ``branch`` also skips the next one, ``loop`` is also led to from the one behind it, and nothing follows ``return``."""
    over = Window.partitionBy(key).orderBy(line)
    rows = statements.select(key, F.col(line).alias("src"), kind.alias("kind"), F.lead(line).over(over).alias("n1"), F.lead(line, 2).over(over).alias("n2"))
    edges = F.array(
        F.when(F.col("kind") != "return", F.struct(F.col("src"), F.col("n1").alias("dst"), F.lit("next").alias("edge"))),
        F.when(F.col("kind") == "branch", F.struct(F.col("src"), F.col("n2").alias("dst"), F.lit("else").alias("edge"))),
        F.when(F.col("kind") == "loop", F.struct(F.col("n1").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("edge"))),
    )
    found = rows.select(key, F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e"))
    return found.select(key, "e.*").filter("src is not null and dst is not null")


def reaching_definitions(edges: DataFrame, defs: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """``key``, ``variable``, ``def_at``, ``node``: definitions that reach the entry of a node in at most ``rounds`` steps (None: all).

    Gen and kill: a definition stops at the next definition of its variable.  ``edges``: ``src``, ``dst``; ``defs``: ``variable``, ``at``."""
    kills = defs.select(key, "variable", F.col("at").alias("node"), F.lit(True).alias("_kill"))
    links = written(edges.select(key, F.col("src").alias("node"), "dst").distinct(), "links")
    front = defs.select(key, "variable", F.col("at").alias("def_at"), F.col("at").alias("node"))
    first, seen, done = True, None, 0
    while rounds is None or done < rounds:
        done += 1
        # what leaves a node: its own definitions, and those that reach it and are not killed there
        leaving = front if first else front.join(kills, [key, "variable", "node"], "left").filter("_kill is null").drop("_kill")
        moved = leaving.join(links, [key, "node"]).select(key, "variable", "def_at", F.col("dst").alias("node")).distinct()
        new = written(moved if seen is None else moved.join(seen, [key, "variable", "def_at", "node"], "left_anti"), "reaching")
        if new.isEmpty():
            break
        seen = new if seen is None else seen.union(new)
        front, first = new, False
    return seen if seen is not None else front.limit(0)


def balanced_reach(edges: DataFrame, seeds: DataFrame, depth: int, context: int) -> DataFrame:
    """What seeds reach on paths whose returns match their calls: ``origin``, ``node``.

    ``edges``: ``src``, ``dst``, ``kind`` (``call`` pushes ``site``, ``return`` has to pop the same, others leave the stack), ``site``.  Stacks deeper than
    ``context`` are an error, not a silent cut.  A return with an empty stack goes on to any caller."""
    seen = written(seeds.select("origin", "node", F.array().cast("array<long>").alias("stack")), "balanced")
    links, front = written(edges.withColumnRenamed("src", "node"), "links"), seen
    for _ in range(depth):
        moved = front.join(links, "node")
        top = F.try_element_at("stack", F.lit(-1))
        fits = (F.col("kind") != "return") | top.isNull() | (top == F.col("site"))
        deep = F.assert_true(F.size("stack") < context, "the call stack is deeper than its bound")
        stack = (
            F.when((F.col("kind") == "call") & deep.isNull(), F.concat("stack", F.array("site")))
            .when((F.col("kind") == "return") & (F.size("stack") > 0), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))))
            .otherwise(F.col("stack"))
        )
        moved = moved.filter(fits).select("origin", F.col("dst").alias("node"), stack.alias("stack")).distinct()
        new = written(moved.join(seen, ["origin", "node", "stack"], "left_anti"), "balanced")
        if new.isEmpty():
            break
        seen, front = seen.union(new), new
    return seen.select("origin", "node").distinct()


def context_balanced(edges: DataFrame, seeds: DataFrame, max_stack: int = 32, max_states: int = 100_000) -> DataFrame:
    """What seeds reach on paths of any length that end with an empty stack: ``origin``, ``node``.

    Edges as in ``balanced_reach``; a return needs its own call on top of the stack.  A call beyond ``max_stack``, or an origin of more than ``max_states``
    states (node, stack), is an error."""
    seen = written(seeds.select("origin", "node", F.array().cast("array<long>").alias("stack")).distinct(), "balanced")
    links, front = written(edges.withColumnRenamed("src", "node"), "links"), seen
    while True:
        if not seen.groupBy("origin").count().filter(F.col("count") > max_states).isEmpty():
            raise ValueError(f"more than {max_states} states of one origin")
        fits = (F.col("kind") != "return") | F.coalesce(F.try_element_at("stack", F.lit(-1)) == F.col("site"), F.lit(False))
        moved = front.join(links, "node").filter(fits & ((F.col("kind") == "call") & F.col("site").isNull()).eqNullSafe(False))
        if not moved.filter((F.col("kind") == "call") & (F.size("stack") >= max_stack)).isEmpty():
            raise ValueError(f"the call stack is deeper than {max_stack}")
        stack = (
            F.when(F.col("kind") == "call", F.concat("stack", F.array("site")))
            .when(F.col("kind") == "return", F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))))
            .otherwise(F.col("stack"))
        )
        moved = moved.select("origin", F.col("dst").alias("node"), stack.alias("stack")).distinct()
        new = written(moved.join(seen, ["origin", "node", "stack"], "left_anti"), "balanced")
        if new.isEmpty():
            return seen.filter(F.size("stack") == 0).select("origin", "node")
        seen, front = seen.union(new), new


def paths_between(edges: DataFrame, seeds: DataFrame, sinks: DataFrame, cutoff: int = 10) -> DataFrame:
    """All simple paths of 1 to ``cutoff`` edges from a seed to a sink (``node``): ``origin``, ``node``, ``path``.

    A path is only carried on where its end can still reach a sink in the steps that are left."""
    links = written(edges.select("src", "dst").distinct(), "links")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = sinks.select("node").distinct()
    left = nearest_origin(back, ends.select(F.col("node").alias("origin"), "node")).select(F.col("node").alias("dst"), F.col("dist").alias("_left")).filter(F.col("_left") < cutoff)
    links = written(links.join(left, "dst"), "links")
    front, every = written(seeds.select("origin", "node", F.array("node").alias("path")).distinct(), "paths"), None
    for step in range(1, cutoff + 1):
        moved = front.join(links, front["node"] == links["src"]).filter((F.col("_left") <= cutoff - step) & ~F.array_contains("path", F.col("dst")))
        front = written(moved.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "paths")
        every = front if every is None else every.union(front)
        if front.isEmpty():
            break
    return every.join(ends, "node", "left_semi").select("origin", "node", "path")


def simple_paths(edges: DataFrame, seeds: DataFrame, cutoff: int) -> DataFrame:
    """All simple paths of at most ``cutoff`` edges from the seeds: ``origin``, ``node``, ``path``.  The number of paths may grow with the degree to the cutoff."""
    links = written(edges.select("src", "dst").distinct(), "links")
    front = written(seeds.select("origin", "node", F.array("node").alias("path")), "paths")
    every = front
    for _ in range(cutoff):
        moved = front.join(links, front["node"] == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        front = written(moved.select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")), "paths")
        if front.isEmpty():
            break
        every = every.union(front)
    return every


def dispatch(calls: DataFrame, methods: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """Resolves each call's (``type``, ``name``) to the nearest type upwards that declares the name: ``call_id``, ``owner``.

    ``methods``: ``type``, ``name``; ``parents``: ``type``, ``parent``."""
    declared = methods.select(F.col("type").alias("at"), "name", F.col("type").alias("owner")).distinct()
    open_ = calls.select("call_id", "name", F.col("type").alias("at"))
    found = None
    for level in range(depth + 1):
        here = open_.join(declared, ["at", "name"], "left")
        done = here.filter("owner is not null").select("call_id", "owner")
        found = done if found is None else found.union(done)
        if level < depth:
            open_ = here.filter("owner is null").join(parents.select(F.col("type").alias("at"), "parent"), "at").select("call_id", "name", F.col("parent").alias("at"))
    return found


def dispatch_all(wanted: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """``type``, ``name``, ``owner``: the nearest type upwards that declares the name, however far; null where the nearest level has several.

    Each (type, name) is looked up once.  ``methods``: ``type``, ``name``; ``parents``: ``type``, ``parent``, which may have cycles."""
    declared = written(methods.select(F.col("type").alias("at"), "name", F.lit(True).alias("_here")).distinct(), "declared")
    up = written(parents.select(F.col("type").alias("at"), "parent").distinct(), "parents")
    seen = written(wanted.select("type", "name", F.col("type").alias("at")).distinct(), "dispatch")
    front, found = seen, None
    while True:
        here = front.join(declared, ["at", "name"], "left")
        done = here.filter("_here").groupBy("type", "name").agg(F.when(F.count_distinct("at") == 1, F.min("at")).alias("owner"))
        done = written(done, "resolved")
        found = done if found is None else found.union(done)
        above = front.join(done, ["type", "name"], "left_anti").join(up, "at").select("type", "name", F.col("parent").alias("at")).distinct()
        front = written(above.join(seen, ["type", "name", "at"], "left_anti"), "dispatch")
        if front.isEmpty():
            return found
        seen = seen.union(front)


def dispatch_targets(wanted: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """``type``, ``name``, ``owner``: the targets of a call over all subtypes of its declared type, itself among them (CHA)."""
    asked = written(wanted.select("type", "name").distinct(), "wanted")
    up = written(parents.select("type", "parent").dropna().distinct(), "parents")
    if up.groupBy("type").count().filter("count > 1").isEmpty():
        return _targets_of_trees(asked, methods, up)
    below = reach(up.select(F.col("parent").alias("src"), F.col("type").alias("dst")), asked.select(F.col("type").alias("origin"), F.col("type").alias("node")))
    of = written(asked.join(below.select(F.col("origin").alias("type"), F.col("node").alias("sub")), "type"), "subtypes")
    owners = dispatch_all(of.select(F.col("sub").alias("type"), "name"), methods, up).filter("owner is not null")
    return of.join(owners.withColumnRenamed("type", "sub"), ["sub", "name"]).select("type", "name", "owner").distinct()


def _targets_of_trees(asked: DataFrame, methods: DataFrame, up: DataFrame) -> DataFrame:
    """``dispatch_targets`` where no type has two parents: what the type itself runs, and every subtype that declares the name.

    A subtype that declares nothing up to the type runs what the type runs; any other one runs what a subtype declares, which is its own target.  So only declaring types are
    followed, and upwards, where near types share what is above them."""
    declared = methods.select("type", "name").dropna().distinct().join(asked.select("name").distinct(), "name", "left_semi")
    declared = written(declared, "declaring")
    own = declared.select(F.col("type").alias("origin"), F.col("type").alias("node")).distinct()
    above = reach(up.select(F.col("type").alias("src"), F.col("parent").alias("dst")), own)
    met = declared.withColumnRenamed("type", "owner").join(above.select(F.col("origin").alias("owner"), F.col("node").alias("type")), "owner").select("type", "name", "owner")
    itself = dispatch_all(asked, methods, up).filter("owner is not null").select("type", "name", "owner")
    return itself.union(met.join(asked, ["type", "name"], "left_semi")).distinct()


def virtual_targets(wanted: DataFrame, methods: DataFrame, supers: DataFrame, interfaces: DataFrame) -> DataFrame:
    """``type``, ``name``, ``target``: the types whose method a virtual call on ``type`` runs.

    The nearest class upwards that declares the name decides: its method if it is concrete, nothing of its own if it is abstract or static.  Without one, the classes below that one (all, if
    none declares it) are asked for the defaults of their interfaces, the highest first; an interface that declares the name hides those it extends.  ``methods``: ``type``, ``name``,
    ``kind`` (``concrete``, ``abstract``, ``static``, ``default``); ``supers``, ``interfaces``: ``type``, ``parent``.  Cycles end where they meet themselves."""
    asked = written(wanted.select("type", "name").distinct(), "wanted")
    known = written(methods.select(F.col("type").alias("at"), "name", "kind").dropDuplicates(["at", "name"]), "methods")
    above = reach(supers.select(F.col("type").alias("src"), F.col("parent").alias("dst")), asked.select(F.col("type").alias("origin"), F.col("type").alias("node")))
    chain = written(asked.join(above.select(F.col("origin").alias("type"), F.col("node").alias("at"), "dist"), "type").join(known, ["at", "name"], "left"), "chain")
    stop = chain.filter("kind is not null").groupBy("type", "name").agg(F.min(F.struct("dist", "at", "kind")).alias("s"))
    own = written(stop.filter("s.kind = 'concrete'").select("type", "name", F.col("s.at").alias("target")), "virtual")
    below = chain.join(stop, ["type", "name"], "left").filter("s is null or dist < s.dist").join(own, ["type", "name"], "left_anti")
    up = written(interfaces.select(F.col("type").alias("at"), "parent").distinct(), "interfaces")
    step = lambda rows: rows.join(up, "at").select("type", "name", "dist", F.col("parent").alias("at")).distinct()
    front = written(step(below.select("type", "name", "dist", "at")), "defaults")
    seen, found = front, None
    while True:
        here = front.join(known, ["at", "name"], "left")
        done = here.filter("kind = 'default'").select("type", "name", "dist", "at")
        found = done if found is None else found.union(done)
        front = written(step(here.filter("kind is null")).join(seen, ["type", "name", "dist", "at"], "left_anti"), "defaults")
        if front.isEmpty():
            break
        seen = seen.union(front)
    highest = found.groupBy("type", "name").agg(F.max("dist").alias("dist"))
    return own.union(found.join(highest, ["type", "name", "dist"]).select("type", "name", F.col("at").alias("target"))).distinct()
