"""Control flow of nested statements: branches, loops, switches, and tries with their catches and finallies.

A statement is a row with the interval of the source that it covers; so is a clause, a part of a statement that holds statements.  What holds what follows from the
intervals alone.  Each compound statement has two nodes, where it begins and where its ways meet again, so every edge is decided by a row, its neighbours and
its ancestors, and nothing walks the tree from the top.  Rows of one function are sorted together; a function is bounded by its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.storage import written

#: Kinds of statements; all others, ``plain`` say, run on to the next.
COMPOUND = ["if", "loop", "switch", "try"]
JUMPS = ["return", "throw", "break", "continue"]
#: Kinds of clauses: of ``if``, of ``loop``, of ``switch``, of ``try``; ``completed`` runs where the guarded part has ended without an exception.
CLAUSES = ["then", "otherwise", "body", "case", "default", "guarded", "catch", "completed", "finally"]
#: Clauses that begin in a node of their own; the others begin in their statement.
_ENTERED = ["case", "default", "catch", "completed", "finally"]
_STARTS = {"then": "true", "otherwise": "false", "body": "true", "guarded": "try", "case": "case-body", "default": "case-body", "catch": "catch", "completed": "completed", "finally": "finally-body"}


def nested(statements: DataFrame, scope: str) -> DataFrame:
    """``scope``, ``id``, ``kind``, ``first``, ``last``, ``depth`` (from 1) and ``parent`` of each row.

    The depth is a running sum over the ends of all intervals; the parent is the last row before it that lies one level higher.  Intervals are half open and nest; of equal ones
    the smaller id is the outer.  Intervals that cross are an error."""
    rows = statements.select(scope, "id", "kind", "first", "last")
    ends = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step"), (-F.col("last")).alias("tie")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step"), F.lit(0).cast(rows.schema["last"].dataType).alias("tie")))
    passed = Window.partitionBy(scope).orderBy("e.at", "e.step", "e.tie", "id").rowsBetween(Window.unboundedPreceding, 0)
    deep = rows.withColumn("e", F.explode(ends)).withColumn("depth", F.sum("e.step").over(passed)).filter("e.step = 1").drop("e")
    # each row once among its own level and once, as a parent, among the level below
    levels = deep.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("below")).withColumn("level", F.col("depth") + F.col("below"))
    before = Window.partitionBy(scope, "level").orderBy("first", F.desc("last"), F.desc("below"), "id").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("below") == 1, F.struct("id", "last")), ignorenulls=True).over(before)
    found = levels.withColumn("p", above).filter("below = 0")
    checked = found.withColumn("_ok", F.assert_true(F.col("p").isNull() | (F.col("p.last") >= F.col("last")), "intervals cross")).filter("_ok is null")
    return checked.select(scope, "id", "kind", "first", "last", "depth", F.col("p.id").alias("parent"))


def ancestors(tree: DataFrame, scope: str) -> DataFrame:
    """``scope``, ``id``, ``up``, ``dist``: all ancestors of each row, the reach doubled in each round."""
    pairs = written(tree.filter("parent is not null").select(scope, "id", F.col("parent").alias("up"), F.lit(1).alias("dist")), "ancestors")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach < deepest - 1:
        low = pairs.filter(F.col("dist") == reach).select(scope, "id", F.col("up").alias("_mid"))
        high = pairs.select(scope, F.col("id").alias("_mid"), "up", (F.col("dist") + reach).alias("dist"))
        pairs = written(pairs.union(low.join(high, [scope, "_mid"]).select(scope, "id", "up", "dist")), "ancestors")
        reach *= 2
    return pairs


def control_flow(statements: DataFrame, scope: str) -> DataFrame:
    """``scope``, ``src``, ``src_at``, ``dst``, ``dst_at``, ``edge``: the control flow of each function.

    ``statements``: ``scope``, ``id``, ``kind`` (of ``COMPOUND``, ``JUMPS``, ``CLAUSES`` or another), ``first``, ``last``.  A node is an id and ``in``, where the statement or clause begins, or ``out``, where a compound
    statement's ways meet; ids are null at ``entry`` and ``exit``.  Jumps, and exceptions that no catch of their try takes, meet every ``finally`` on their way, from the inside out, and go on
    from its end (``finally-resume``).  Any statement under ``guarded`` may raise.  A ``break`` or ``continue`` outside of what it leaves runs on.  No rows, no edges; statements behind a jump have no way in."""
    tree = written(nested(statements, scope), "statement-tree")
    clause = F.col("kind").isin(CLAUSES)
    siblings = Window.partitionBy(scope, "parent").orderBy("first", F.desc("last"), "id")
    rows = tree.withColumns({"nxt": F.lead("id").over(siblings), "is_first": F.lag("id").over(siblings).isNull()})

    # what a statement's clauses are
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("id")))
    parts = rows.filter(clause).groupBy(scope, F.col("parent").alias("owner")).agg(
        one("finally").alias("fin"), one("completed").alias("completed"), one("catch").alias("any_catch"), one("otherwise").alias("any_else"), one("default").alias("any_default")
    )
    clauses = rows.filter(clause).withColumnRenamed("parent", "owner").join(parts, [scope, "owner"])
    leaving = F.when(F.col("kind").isin("guarded", "catch", "completed"), F.col("fin"))

    # what lies above each statement, from the inside out
    kinds = tree.select(scope, F.col("id").alias("up"), F.col("kind").alias("up_kind"))
    crossed = clauses.select(scope, F.col("id").alias("up"), leaving.alias("fin"), F.when(F.col("kind") == "guarded", F.col("owner")).alias("guarded_by"), F.col("any_catch"))
    over = ancestors(tree, scope).join(tree.filter(~clause).select(scope, "id"), [scope, "id"]).join(kinds, [scope, "up"]).join(crossed, [scope, "up"], "left")
    over = written(over.select(scope, "id", "up", "dist", "up_kind", "fin", "guarded_by", "any_catch"), "statement-ancestors")
    above = over.groupBy(scope, "id").agg(F.array_sort(F.collect_list(F.struct("dist", "up", "up_kind", "fin"))).alias("above"))

    # where jumps lead
    left = tree.filter(F.col("kind").isin(JUMPS)).select(scope, "id", "kind").join(above, [scope, "id"], "left")
    left = left.withColumn("above", F.coalesce("above", F.array().cast(above.schema["above"].dataType)))
    inner = lambda *k: F.try_element_at(F.filter("above", lambda a: a["up_kind"].isin(*k)), F.lit(1))
    goal = F.when(F.col("kind") == "break", inner("loop", "switch")).when(F.col("kind") == "continue", inner("loop"))
    far = F.lit(1 << 30)
    jumps = left.withColumn("g", goal).filter(F.col("kind").isin("return", "throw") | F.col("g").isNotNull())
    place = F.when(F.col("g").isNull(), "exit").when(F.col("kind") == "break", "out").otherwise("in")
    jumps = jumps.select(scope, "id", F.when(F.col("g").isNull(), "terminal").otherwise(F.col("kind")).alias("way"), F.lit(0).alias("since"), F.coalesce("g.dist", far).alias("until"), F.col("g.up").alias("goal"), place.alias("goal_at"), "above")
    raised = over.filter("guarded_by is not null and any_catch is null").join(above, [scope, "id"])
    raised = raised.select(scope, "id", F.lit("uncaught").alias("way"), F.col("dist").alias("since"), far.alias("until"), F.lit(None).cast(tree.schema["id"].dataType).alias("goal"), F.lit("exit").alias("goal_at"), "above")
    met = F.transform(F.filter("above", lambda a: a["fin"].isNotNull() & (a["dist"] >= F.col("since")) & (a["dist"] < F.col("until"))), lambda a: F.struct(a["fin"].alias("node"), F.lit("in").alias("at")))
    ways = jumps.union(raised).withColumn("hops", F.concat(met, F.array(F.struct(F.col("goal").alias("node"), F.col("goal_at").alias("at")))))

    # where a statement and a clause end
    stays = rows.join(jumps.select(scope, "id", F.lit(True).alias("jumps")), [scope, "id"], "left").filter(~clause & F.col("jumps").isNull())
    tails = stays.withColumn("at", F.when(F.col("kind").isin(COMPOUND), "out").otherwise("in"))
    begin, begin_at = F.when(F.col("kind").isin(_ENTERED), F.col("id")).otherwise(F.col("owner")), F.lit("in")
    filled = rows.filter(~clause & F.col("parent").isNotNull()).select(scope, F.col("parent").alias("id")).distinct().withColumn("filled", F.lit(True))
    last_of = tails.filter("nxt is null").select(scope, F.col("parent").alias("id"), F.col("id").alias("tail"), F.col("at").alias("tail_at"))
    ended = clauses.join(filled, [scope, "id"], "left").join(last_of, [scope, "id"], "left")
    ended = ended.withColumns({"tail": F.when(F.col("filled"), F.col("tail")).otherwise(begin), "tail_at": F.when(F.col("filled"), F.col("tail_at")).otherwise(begin_at)}).filter("tail is not null")
    ended = written(ended, "clause-ends")

    def edges(df: DataFrame, src: Column | str, src_at: Column | str, dst: Column | str, dst_at: Column | str, edge: Column | str) -> DataFrame:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        node = lambda x: (F.col(x) if isinstance(x, str) else x).cast(tree.schema["id"].dataType)
        return df.select(scope, node(src).alias("src"), text(src_at).alias("src_at"), node(dst).alias("dst"), text(dst_at).alias("dst_at"), text(edge).alias("edge"))

    none, own = F.lit(None), clauses.select(scope, F.col("id").alias("parent"), F.col("kind").alias("of"), "owner")
    start_label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in _STARTS.items() for x in p)), F.col("of")), F.lit("next"))
    firsts = rows.filter(~clause & F.col("is_first") & F.col("parent").isNotNull()).join(own, [scope, "parent"])
    next_case = F.col("kind").isin("case", "default") & F.col("nxt").isNotNull()
    tried = F.col("kind").isin("guarded", "catch", "completed")
    onward = [
        (next_case, F.col("nxt"), "in", "fallthrough"), (F.col("kind").isin("case", "default"), F.col("owner"), "out", "case-complete"),
        (F.col("kind").isin("then", "otherwise"), F.col("owner"), "out", "join"), (F.col("kind") == "body", F.col("owner"), "in", "loop-back"),
        ((F.col("kind") == "guarded") & F.col("completed").isNotNull(), F.col("completed"), "in", "completed"), (tried & F.col("fin").isNotNull(), F.col("fin"), "in", "finally"),
        (tried, F.col("owner"), "out", "try-complete"), (F.col("kind") == "finally", F.col("owner"), "out", "finally-complete"),
    ]
    to = F.coalesce(*(F.when(c, F.struct(n.alias("node"), F.lit(at).alias("at"), F.lit(e).alias("edge"))) for c, n, at, e in onward))
    straight = rows.filter(F.col("kind").isin("if", "loop", "switch")).join(parts.withColumnRenamed("owner", "id"), [scope, "id"], "left")
    straight = straight.filter((F.col("kind") == "loop") | (F.col("kind") == "if") & F.col("any_else").isNull() | (F.col("kind") == "switch") & F.col("any_default").isNull())
    # a try without any clause runs through
    bare = rows.filter("kind = 'try'").join(clauses.select(scope, F.col("owner").alias("id")), [scope, "id"], "left_anti")
    chosen = clauses.filter(F.col("kind").isin("case", "default"))
    catches = clauses.filter("kind = 'catch'").select(scope, F.col("owner").alias("guarded_by"), F.col("id").alias("catch"))
    named = F.when(F.size("hops") > 1, F.concat("way", F.lit("-finally"))).otherwise(F.col("way"))
    resumed = ways.filter(F.size("hops") > 1).select(scope, F.explode(F.arrays_zip(F.slice("hops", 1, F.size("hops") - 1).alias("a"), F.slice("hops", 2, F.size("hops") - 1).alias("b"))).alias("h"))
    resumed = resumed.select(scope, F.col("h.a.node").alias("id"), "h.b").distinct().join(ended.select(scope, "id", "tail", "tail_at"), [scope, "id"])
    every = [
        edges(tails.filter("nxt is not null"), "id", F.col("at"), "nxt", "in", "next"),
        edges(rows.filter(~clause & F.col("is_first") & F.col("parent").isNull()), none, "entry", "id", "in", "next"),
        edges(tails.filter("parent is null and nxt is null"), "id", F.col("at"), none, "exit", "next"),
        edges(firsts, F.when(F.col("of").isin(_ENTERED), F.col("parent")).otherwise(F.col("owner")), "in", "id", "in", start_label),
        edges(ended.withColumn("to", to), "tail", F.col("tail_at"), F.col("to.node"), F.col("to.at"), F.col("to.edge")),
        edges(straight, "id", "in", "id", "out", F.when(F.col("kind") == "switch", "no-match").otherwise("false")),
        edges(bare, "id", "in", "id", "out", "try-complete"),
        edges(chosen, "owner", "in", "id", "in", F.col("kind")),
        edges(catches, "guarded_by", "in", "catch", "in", "exception-dispatch"),
        edges(over.filter("guarded_by is not null").join(catches, [scope, "guarded_by"]), "id", "in", "catch", "in", "exception"),
        edges(ways, "id", "in", F.col("hops")[0]["node"], F.col("hops")[0]["at"], named),
        edges(resumed, "tail", F.col("tail_at"), F.col("b.node"), F.col("b.at"), "finally-resume"),
    ]
    return reduce(DataFrame.union, every).distinct()
