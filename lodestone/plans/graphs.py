"""Graph, flow and neighbourhood queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from lodestone.operators import graph as op
from lodestone.plans.registry import query

SEEDS = "select fn_id as origin, fn_id as node from functions_v where name = 'f1'"


def _seeds(t):
    """Entry points: functions whose name says so."""
    rows = t.functions_v.filter("name = 'f1'")
    return rows.select(F.col("fn_id").alias("origin"), F.col("fn_id").alias("node"))


def _walk(depth: int, edges: str = "edges_v", seeds: str = SEEDS) -> str:
    steps = [f"w0 as (select origin, node, 0 as dist from ({seeds}))"]
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select origin, node from w{i}" for i in range(k))
        steps.append(f"w{k} as (select distinct origin, e.dst as node, {k} as dist from w{k - 1} w join {edges} e on e.src = w.node where (origin, e.dst) not in ({seen.replace('select origin, node', 'select (origin, node)')}))")
    return "with " + ", ".join(steps) + ", walk as (" + " union all ".join(f"select * from w{k}" for k in range(depth + 1)) + ") "


def _closure(edges: str = "edges_v", seeds: str = SEEDS) -> str:
    """``walk`` over any number of steps: the rows of a step are those whose key has none yet."""
    return (
        f"with recursive walk(origin, node, dist) using key (origin, node) as (select origin, node, 0 from ({seeds}) union select w.origin, e.dst, min(w.dist + 1) from walk w join {edges} e on e.src = w.node "
        "left join recurring.walk k on k.origin = w.origin and k.node = e.dst where k.node is null group by 1, 2) "
    )


@query("gr01_degrees", "select f.fn_id, coalesce(o.n, 0) as calls_out, coalesce(i.n, 0) as calls_in from functions_v f left join (select src, count(*) as n from edges_v group by 1) o on o.src = fn_id left join (select dst, count(*) as n from edges_v group by 1) i on i.dst = fn_id")
def gr01(t):
    out = t.edges_v.groupBy(F.col("src").alias("fn_id")).agg(F.count(F.lit(1)).alias("o"))
    into = t.edges_v.groupBy(F.col("dst").alias("fn_id")).agg(F.count(F.lit(1)).alias("i"))
    rows = t.functions_v.select("fn_id").join(out, "fn_id", "left").join(into, "fn_id", "left")
    return rows.select("fn_id", F.coalesce("o", F.lit(0)).alias("calls_out"), F.coalesce("i", F.lit(0)).alias("calls_in"))


@query("gr02_flags", "select fn_id, regexp_matches(name, '^f(1|2)$') as is_entry, contains(qualified_name, '.m7.') as is_sink from functions_v")
def gr02(t):
    return t.functions_v.select("fn_id", F.col("name").rlike("^f(1|2)$").alias("is_entry"), F.contains("qualified_name", F.lit(".m7.")).alias("is_sink"))


@query("gr03_reachable", "with recursive r(origin, node) as (select fn_id, fn_id from functions_v where name = 'f1' union select origin, dst from r join edges_v on src = node) select origin, node from r")
def gr03(t):
    return op.reach(t.edges_v, _seeds(t)).select("origin", "node")


@query("gr05_distances_within", _walk(3) + "select origin, node, dist from walk")
def gr05(t):
    return op.reach(t.edges_v, _seeds(t), 3)


@query("gr05_distances", _closure() + "select origin, node, dist from walk")
def gr05_all(t):
    return op.reach(t.edges_v, _seeds(t))


@query("gr05_shortest_parents_within", _walk(3) + "select w.origin, w.node, w.dist, (select min(p.node) from walk p join edges_v e on e.src = p.node and e.dst = w.node where p.origin = w.origin and p.dist = w.dist - 1) as parent from walk w")
def gr05_parents(t):
    return op.shortest_tree(t.edges_v, _seeds(t), 3)


@query("gr05_shortest_parents", _closure() + "select w.origin, w.node, any_value(w.dist) as dist, min(p.node) as parent from walk w left join edges_v e on e.dst = w.node left join walk p on p.origin = w.origin and p.node = e.src and p.dist = w.dist - 1 group by 1, 2")
def gr05_all_parents(t):
    return op.shortest_tree(t.edges_v, _seeds(t))


@query("gr06_neighbours", "select src as fn_id, count(distinct dst) as callees, string_agg(distinct overlay, ',' order by overlay) as overlays from edges_v group by 1")
def gr06(t):
    return t.edges_v.groupBy(F.col("src").alias("fn_id")).agg(F.count_distinct("dst").alias("callees"), F.array_join(F.array_sort(F.collect_set("overlay")), ",").alias("overlays"))


@query("gr07_overlay_reach_within", _walk(4, "(select * from edges_v where overlay in ('call', 'cfg'))") + "select origin, node, dist from walk")
def gr07(t):
    return op.reach(t.edges_v.filter(F.col("overlay").isin("call", "cfg")), _seeds(t), 4)


@query("gr07_overlay_reach", _closure("(select * from edges_v where overlay in ('call', 'cfg'))") + "select origin, node, dist from walk")
def gr07_all(t):
    return op.reach(t.edges_v.filter(F.col("overlay").isin("call", "cfg")), _seeds(t))


@query("gr08_source_sink_within", _walk(3) + "select origin, node as sink, dist from walk where node in (select fn_id from functions_v where name = 'f7') order by dist, origin, sink limit 100")
def gr08(t):
    """The first hundred are the feature: the enumeration has a limit of paths."""
    sinks = t.functions_v.filter("name = 'f7'").select(F.col("fn_id").alias("node"))
    found = op.reach(t.edges_v, _seeds(t), 3, sinks)
    return found.orderBy("dist", "origin", "node").limit(100).select("origin", F.col("node").alias("sink"), "dist")


@query("gr08_source_sink", _closure() + "select origin, node as sink, dist from walk where node in (select fn_id from functions_v where name = 'f7') order by dist, origin, sink limit 100")
def gr08_all(t):
    """Paths of any length; the limit of paths is the feature."""
    sinks = t.functions_v.filter("name = 'f7'").select(F.col("fn_id").alias("node"))
    found = op.reach(t.edges_v, _seeds(t), targets=sinks)
    return found.orderBy("dist", "origin", "node").limit(100).select("origin", F.col("node").alias("sink"), "dist")


@query("gr11_nearest_entry_within", _walk(3) + "select node, min(dist) as dist, arg_min(origin, (dist, origin)) as entry from walk group by 1")
def gr11(t):
    best = op.reach(t.edges_v, _seeds(t), 3).groupBy("node").agg(F.min(F.struct("dist", "origin")).alias("b"))
    return best.select("node", "b.dist", F.col("b.origin").alias("entry"))


@query("gr11_nearest_entry", _closure() + "select node, min(dist) as dist, arg_min(origin, (dist, origin)) as entry from walk group by 1")
def gr11_all(t):
    return op.nearest_origin(t.edges_v, _seeds(t)).select("node", "dist", F.col("origin").alias("entry"))


@query("gr12_reverse_paths_within", _walk(2, "(select dst as src, src as dst from edges_v)") + "select origin, node, dist from walk")
def gr12(t):
    return op.reach(t.edges_v.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _seeds(t), 2)


@query("gr12_reverse_paths", _closure("(select dst as src, src as dst from edges_v)") + "select origin, node, dist from walk")
def gr12_all(t):
    return op.reach(t.edges_v.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _seeds(t))


@query("gr13_neighbourhood", _walk(2, "(select src, dst from edges_v union select dst, src from edges_v)", "select 7 as origin, 7 as node") + "select src, dst, overlay from edges_v where src in (select node from walk) and dst in (select node from walk)")
def gr13(t):
    seed = t.functions_v.filter("fn_id = 7").select(F.col("fn_id").alias("origin"), F.col("fn_id").alias("node"))
    near = op.reach(op.undirected(t.edges_v), seed, 2)
    return op.induced(t.edges_v, near).select("src", "dst", "overlay")


@query("gr14_summary_graph", "with hot as (select src as node from edges_v group by 1 order by count(*) desc, 1 limit 50) select src, dst, overlay from edges_v where src in (select node from hot) and dst in (select node from hot)")
def gr14(t):
    """A budget of fifty nodes is the feature."""
    hot = t.edges_v.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(50).select(F.col("src").alias("node"))
    return op.induced(t.edges_v, hot).select("src", "dst", "overlay")


@query("ag16_graph_counters", "select overlay, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from edges_v group by 1")
def ag16(t):
    return t.edges_v.groupBy("overlay").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("gr22_membership", "select distinct f.file_path as a, g.file_path as b from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id where overlay = 'call' and f.file_path <> g.file_path")
def gr22(t):
    files = t.functions_v.select("fn_id", "file_path")
    pairs = t.edges_v.filter("overlay = 'call'").join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst")
    return pairs.filter("a != b").select("a", "b").distinct()


@query("gr25_taint_edges", "select src, dst, case when min(overlay) = 'call' then 0.9 else 0.4 end as confidence from edges_v where overlay in ('call', 'semantic') group by 1, 2")
def gr25(t):
    e = t.edges_v.filter(F.col("overlay").isin("call", "semantic")).groupBy("src", "dst").agg(F.min("overlay").alias("o"))
    return e.select("src", "dst", F.when(F.col("o") == "call", 0.9).otherwise(0.4).alias("confidence"))


@query("tn01_by_names", "select fn_id, case when name in ('f1', 'f2') then 'source' when contains(qualified_name, '.m7.') then 'sink' end as kind from functions_v where name in ('f1', 'f2') or contains(qualified_name, '.m7.')")
def tn01(t):
    kind = F.when(F.col("name").isin("f1", "f2"), "source").when(F.contains("qualified_name", F.lit(".m7.")), "sink")
    return t.functions_v.select("fn_id", kind.alias("kind")).filter("kind is not null")


def _flow(depth: int) -> str:
    steps = ["w0 as (select origin, node, false as clean, 0 as dist from (" + SEEDS + "))"]
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select (origin, node, clean) from w{i}" for i in range(k))
        steps.append(f"w{k} as (select distinct origin, e.dst as node, (clean or e.dst in (select fn_id from functions_v where name in ('f5', 'f10', 'f15'))) as clean, {k} as dist from w{k - 1} w join edges_v e on e.src = w.node where (origin, e.dst, (clean or e.dst in (select fn_id from functions_v where name in ('f5', 'f10', 'f15')))) not in ({seen}))")
    return "with " + ", ".join(steps) + ", walk as (" + " union all ".join(f"select * from w{k}" for k in range(depth + 1)) + ") "


@query("tn02_flows_within", _flow(3) + "select origin, node, (arg_min(struct_pack(c := clean, d := dist), (clean, dist))).c as clean, (arg_min(struct_pack(c := clean, d := dist), (clean, dist))).d as dist from walk group by 1, 2")
def tn02(t):
    """TN02, TN07, TN08, WN08 within three steps: facts flow along edges; a sanitiser marks them; the best flow of each (origin, node) stays."""
    blocked = t.functions_v.filter("name in ('f5', 'f10', 'f15')").select(F.col("fn_id").alias("node"))
    return op.propagate(t.edges_v, _seeds(t), blocked, 3)


CLEAN = "(w.clean or e.dst in (select fn_id from functions_v where name in ('f5', 'f10', 'f15')))"


@query(
    "tn02_flows",
    f"""with recursive walk(origin, node, clean, dist) using key (origin, node, clean) as (select origin, node, false, 0 from ({SEEDS}) union select w.origin, e.dst, {CLEAN}, min(w.dist + 1) from walk w join edges_v e on e.src = w.node
      left join recurring.walk k on k.origin = w.origin and k.node = e.dst and k.clean = {CLEAN} where k.node is null group by 1, 2, 3)
    select origin, node, bool_and(clean) as clean, arg_min(dist, (clean, dist)) as dist from walk group by 1, 2""",
)
def tn02_all(t):
    """TN02 to its fixed point: a node is clean only if no flow of any length reaches it unsanitised."""
    blocked = t.functions_v.filter("name in ('f5', 'f10', 'f15')").select(F.col("fn_id").alias("node"))
    return op.propagate(t.edges_v, _seeds(t), blocked)


@query(
    "tn09_line_heuristic",
    """with s as (select distinct file_path, min(line) as line from calls_v where callee = 'f1' group by 1) select c.k_order, c.k_line, c.k_part, c.k_supp, c.k_price, s.line as source_line from calls_v c join s on c.file_path = s.file_path and c.line > s.line where callee = 'f7'""",
)
def tn09(t):
    first = t.calls_v.filter("callee = 'f1'").groupBy("file_path").agg(F.min("line").alias("source_line"))
    return t.calls_v.filter("callee = 'f7'").join(first, "file_path").filter("line > source_line").select("k_order", "k_line", "k_part", "k_supp", "k_price", "source_line")


STOPPED = "(w.clean or exists (select 1 from functions_v s where s.fn_id = e.dst and (s.name = 'f5' or (s.name = 'f10' and w.category = 'sql') or (s.name = 'f15' and w.category = 'path'))))"


@query(
    "tn08_sink_flows",
    f"""with recursive walk(origin, node, category, clean, dist) using key (origin, node, category, clean) as (select origin, node, category, false, 0 from ({SEEDS}), (values ('sql'), ('path')) v(category)
      union select w.origin, e.dst, w.category, {STOPPED}, min(w.dist + 1) from walk w join edges_v e on e.src = w.node left join recurring.walk k on k.origin = w.origin and k.node = e.dst and k.category = w.category and k.clean = {STOPPED} where k.node is null group by 1, 2, 3, 4)
    select origin, node, category, bool_and(clean) as sanitized, arg_min(dist, (clean, dist)) as dist from walk join functions_v f on f.fn_id = node where (category = 'sql' and name in ('f7', 'f8')) or (category = 'path' and name in ('f8', 'f9')) group by 1, 2, 3""",
)
def tn08(t):
    """TN07, TN08: flows into sinks of two categories; sanitizers stop all, or one of them."""
    named = lambda pairs: functools.reduce(lambda a, b: a.union(b), (t.functions_v.filter(F.col("name") == n).select(F.col("fn_id").alias("node"), F.lit(c).alias("category")) for n, c in pairs))
    sinks = named([("f7", "sql"), ("f8", "sql"), ("f8", "path"), ("f9", "path")])
    return op.flows(t.edges_v, _seeds(t), sinks, named([("f5", "*"), ("f10", "sql"), ("f15", "path")]))
