"""Queries on control flow, dataflow, contexts, dispatch and resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import flow as op
from lodestone.operators import joins, rules, ssa, structure
from lodestone.operators.digests import joined_sha256
from lodestone.plans.registry import query

KIND = "case when n_chars % 7 = 0 then 'return' when role = 'user' then 'branch' when n_chars % 5 = 0 then 'loop' else 'plain' end"
EDGES = f"""k as (select conv_id, turn as src, {KIND} as kind, lead(turn) over w as n1, lead(turn, 2) over w as n2 from turns_v window w as (partition by conv_id order by turn)),
    e as (select conv_id, src, n1 as dst, 'next' as edge from k where kind <> 'return' and n1 is not null union all select conv_id, src, n2, 'else' from k where kind = 'branch' and n2 is not null
      union all select conv_id, n1, src, 'back' from k where kind = 'loop' and n1 is not null)"""


def _edges(t):
    kind = F.when(F.col("n_chars") % 7 == 0, "return").when(F.col("role") == "user", "branch").when(F.col("n_chars") % 5 == 0, "loop").otherwise("plain")
    return op.control_edges(t.turns_v, "conv_id", "turn", kind)


@query("gr19_control_flow", f"with {EDGES} select conv_id, src, dst, edge from e")
def gr19(t):
    return _edges(t)


@query(
    "gr19_nested_flow",
    """with a as (select s.fn, s.id, s.kind as own, x.id as up, x.kind, x.first from nested_v s join nested_v x on x.fn = s.fn and x.first < s.first and x.last > s.last),
      t as (select n.*, p.parent, lead(n.id) over w as nxt, lag(n.id) over w is null as is_first, n.kind in ('then', 'otherwise', 'body', 'case', 'default', 'guarded', 'catch', 'finally') as clause
        from nested_v n left join (select fn, id, arg_max(up, first) as parent from a group by 1, 2) p using (fn, id) window w as (partition by n.fn, parent order by n.first)),
      fin as (select fn, parent as owner, id as fin from t where kind = 'finally'), cat as (select fn, parent as owner, id as cat from t where kind = 'catch'),
      x as (select a.*, c.parent as owner, fin.fin, cat.cat from a left join t c on c.fn = a.fn and c.id = a.up and a.kind in ('guarded', 'catch') left join fin on fin.fn = a.fn and fin.owner = c.parent left join cat on cat.fn = a.fn and cat.owner = c.parent),
      j as (select t.fn, t.id, t.kind, arg_max(a.up, a.first) as goal, coalesce(max(a.first), -1) as since from t left join a on a.fn = t.fn and a.id = t.id and (t.kind = 'break' and a.kind in ('loop', 'switch') or t.kind = 'continue' and a.kind = 'loop')
        where t.kind in ('return', 'throw', 'break', 'continue') group by 1, 2, 3),
      ways as (select fn, id, case when goal is null then 'terminal' else kind end as way, goal, case when goal is null then 'exit' when kind = 'break' then 'out' else 'in' end as goal_at, since, 99999 as upto from j where goal is not null or kind in ('return', 'throw')
        union all select fn, id, 'uncaught', null, 'exit', -1, first from x where kind = 'guarded' and cat is null and own not in ('then', 'otherwise', 'body', 'case', 'default', 'guarded', 'catch', 'finally')),
      hops as (select w.fn, w.id, way, upto, x.first as ord, x.fin as node, 'in' as spot from ways w join x on x.fn = w.fn and x.id = w.id and x.fin is not null and x.first > w.since and x.first <= w.upto union all select fn, id, way, upto, -2, goal, goal_at from ways),
      h as (select *, lead(node) over v as node2, lead(spot) over v as spot2, row_number() over v as nth from hops window v as (partition by fn, id, way, upto order by ord desc)),
      tails as (select *, case when kind in ('if', 'loop', 'switch', 'try') then 'out' else 'in' end as spot from t where not clause and id not in (select id from j where goal is not null or kind in ('return', 'throw'))),
      ends as (select c.*, l.id as tail, l.spot as tail_at from t c join tails l on l.fn = c.fn and l.parent = c.id and l.nxt is null where c.clause),
      e as (select fn, id as src, spot as src_at, nxt as dst, 'in' as dst_at, 'next' as edge from tails where nxt is not null
        union all select fn, null, 'entry', id, 'in', 'next' from t where parent is null and is_first union all select fn, id, spot, null, 'exit', 'next' from tails where parent is null and nxt is null
        union all select f.fn, case when c.kind in ('case', 'default', 'catch', 'finally') then c.id else c.parent end, 'in', f.id, 'in', case c.kind when 'otherwise' then 'false' when 'guarded' then 'try' when 'catch' then 'catch' when 'finally' then 'finally-body' when 'case' then 'case-body' when 'default' then 'case-body' else 'true' end
          from t f join t c on c.fn = f.fn and c.id = f.parent where f.is_first and not f.clause
        union all select fn, tail, tail_at, case kind when 'case' then nxt when 'guarded' then coalesce(fin, parent) else parent end, case when kind in ('case', 'body') or kind = 'guarded' and fin is not null then 'in' else 'out' end,
          case kind when 'case' then 'fallthrough' when 'default' then 'case-complete' when 'body' then 'loop-back' when 'guarded' then case when fin is null then 'try-complete' else 'finally' end when 'catch' then 'try-complete' when 'finally' then 'finally-complete' else 'join' end
          from (select ends.*, fin.fin from ends left join fin on fin.fn = ends.fn and fin.owner = ends.parent)
        union all select fn, id, 'in', id, 'out', 'false' from t where kind = 'loop' union all select fn, parent, 'in', id, 'in', kind from t where kind in ('case', 'default')
        union all select fn, owner, 'in', cat, 'in', 'exception-dispatch' from cat
        union all select fn, id, 'in', cat, 'in', 'exception' from x where kind = 'guarded' and cat is not null and own not in ('then', 'otherwise', 'body', 'case', 'default', 'guarded', 'catch', 'finally')
        union all select fn, id, 'in', node, spot, way || case when ord = -2 then '' else '-finally' end from h where nth = 1
        union all select h.fn, tail, tail_at, node2, spot2, 'finally-resume' from h join ends on ends.fn = h.fn and ends.id = h.node and ends.kind = 'finally' where h.ord > -2)
    select distinct * from e""",
)
def gr19_nested(t):
    """Edges of nested statements with their joins; the SQL finds what holds what by comparing all intervals of a function."""
    return structure.control_flow(t.nested_v, "fn")


@query(
    "gr20_reaching_definitions",
    f"""with recursive {EDGES}, d as (select conv_id, role as variable, turn as at from turns_v where n_chars > 100), r(conv_id, variable, def_at, node, own) as (
      select d.conv_id, d.variable, d.at, e.dst, false from d join e on e.conv_id = d.conv_id and e.src = d.at
      union select r.conv_id, r.variable, r.def_at, e.dst, false from r join e on e.conv_id = r.conv_id and e.src = r.node
        where not exists (select 1 from d where d.conv_id = r.conv_id and d.variable = r.variable and d.at = r.node))
    select distinct conv_id, variable, def_at, node from r""",
)
def gr20(t):
    defs = t.turns_v.filter("n_chars > 100").select("conv_id", F.col("role").alias("variable"), F.col("turn").alias("at"))
    return op.reaching_definitions(_edges(t), defs, "conv_id")


@query(
    "gr20_phi_nodes",
    f"""with recursive {EDGES}, n as (select conv_id, turn as node from turns_v), s as (select conv_id, min(turn) as entry from turns_v group by 1), d as (select conv_id, role as variable, turn as node from turns_v where n_chars > 100),
      r(conv_id, skipped, node) as (select n.conv_id, n.node, entry from n join s using (conv_id) where n.node <> entry union all select conv_id, -1, entry from s
        union select r.conv_id, skipped, e.dst from r join e on e.conv_id = r.conv_id and e.src = r.node where e.dst <> skipped),
      m as (select w.conv_id, w.node, n.node as dom from r w join n on n.conv_id = w.conv_id where w.skipped = -1 and not exists (select 1 from r x where x.conv_id = w.conv_id and x.skipped = n.node and x.node = w.node)),
      f as (select distinct e.conv_id, m.dom as node, e.dst as frontier from e join m on m.conv_id = e.conv_id and m.node = e.src where not exists (select 1 from m y where y.conv_id = e.conv_id and y.node = e.dst and y.dom = m.dom and m.dom <> e.dst)),
      p(conv_id, variable, node, phi) as (select conv_id, variable, node, false from d where (conv_id, node) in (select (conv_id, node) from m)
        union select p.conv_id, variable, frontier, true from p join f on f.conv_id = p.conv_id and f.node = p.node)
    select distinct conv_id, variable, node from p where phi""",
)
def gr20_phis(t):
    """Where the definitions of a role meet: the iterated dominance frontiers of each conversation's control flow."""
    entries = t.turns_v.groupBy("conv_id").agg(F.min("turn").alias("node"))
    defs = t.turns_v.filter("n_chars > 100").select("conv_id", F.col("role").alias("variable"), F.col("turn").alias("at"))
    return ssa.phi_nodes(_edges(t), entries, defs, "conv_id")


@query(
    "gr20_def_use",
    """select a.conv_id, a.turn as def_at, min(b.turn) as use_at from turns_v a join turns_v b on a.conv_id = b.conv_id and a.role = b.role and b.turn > a.turn group by 1, 2""",
)
def gr20_def_use(t):
    use = F.lead("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return t.turns_v.select("conv_id", F.col("turn").alias("def_at"), use.alias("use_at")).filter("use_at is not null")


@query(
    "gr09_balanced_paths_within",
    """with recursive e as (select src, dst, 'call' as kind, callsite_id as site from edges_v where overlay = 'call' union all select dst, src, 'return', callsite_id from edges_v where overlay = 'call'),
    r(origin, node, stack, d) as (select fn_id, fn_id, []::bigint[], 0 from functions_v where name = 'f1'
      union select origin, e.dst, case when kind = 'call' then list_append(stack, site) when len(stack) > 0 then list_slice(stack, 1, len(stack) - 1) else stack end, d + 1
      from r join e on e.src = r.node where d < 3 and (kind = 'call' or len(stack) = 0 or stack[-1] = site))
    select distinct origin, node from r""",
)
def gr09(t):
    """Calls and returns from the entry points, three steps: a return pops the site that its call has pushed."""
    calls = t.edges_v.filter("overlay = 'call'").select("src", "dst", F.lit("call").alias("kind"), F.col("callsite_id").alias("site"))
    returns = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("return").alias("kind"), "site")
    seeds = t.functions_v.filter("name = 'f1'").select(F.col("fn_id").alias("origin"), F.col("fn_id").alias("node"))
    return op.balanced_reach(calls.union(returns), seeds, 3, 8)


@query(
    "gr04_simple_paths_within",
    """with e as (select distinct src, dst from edges_v where overlay = 'cfg'), s as (select fn_id as o from functions_v where name = 'f1'),
    a as (select o, dst as n1 from s join e on src = o where dst <> o), b as (select o, n1, dst as n2 from a join e on src = n1 where dst not in (o, n1))
    select o as origin, o as node, o::varchar as path from s union all select o, n1, o || '>' || n1 from a union all select o, n2, o || '>' || n1 || '>' || n2 from b""",
)
def gr04(t):
    seeds = t.functions_v.filter("name = 'f1'").select(F.col("fn_id").alias("origin"), F.col("fn_id").alias("node"))
    paths = op.simple_paths(t.edges_v.filter("overlay = 'cfg'"), seeds, 2)
    return paths.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(
    "gr04_simple_paths",
    f"""with recursive {EDGES}, g as (select distinct conv_id, src, dst from e), s as (select conv_id, min(turn) as origin from turns_v group by 1), z as (select conv_id, src as node from k where kind = 'return'),
      r(conv_id, origin, node, path) as (select conv_id, origin, origin, [origin] from s union all select r.conv_id, origin, g.dst, list_append(path, g.dst) from r join g on g.conv_id = r.conv_id and g.src = r.node
        where len(path) <= 10 and not list_contains(path, g.dst))
    select conv_id, origin, node, array_to_string(path, '>') as path from r join z using (conv_id, node) where len(path) > 1""",
)
def gr04_whole(t):
    """All simple paths of up to ten edges from a conversation's first turn to a turn that returns."""
    at = lambda turn: F.struct("conv_id", F.col(turn).alias("turn"))
    edges = _edges(t).select(at("src").alias("src"), at("dst").alias("dst"))
    first = t.turns_v.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(at("turn").alias("origin"), at("turn").alias("node"))
    paths = op.paths_between(edges, first, t.turns_v.filter("n_chars % 7 = 0").select(at("turn").alias("node")))
    shown = F.array_join(F.transform("path", lambda x: x["turn"].cast("string")), ">")
    return paths.select("origin.conv_id", F.col("origin.turn").alias("origin"), F.col("node.turn").alias("node"), shown.alias("path"))


@query(
    "gr09_balanced_paths",
    """with recursive c as (select p_partkey as src, p_partkey // 3 as dst, p_partkey as site from part where p_partkey >= 3),
    e as (select src, dst, 'call' as kind, site from c union all select q.dst, c.src, 'return', c.site from c join (select dst as at, dst from c union select dst, dst + 1 from c) q on q.at = c.dst
      union all select p_partkey, p_partkey + 1, 'cfg', null from part where p_partkey % 3 = 0),
    r(origin, node, stack) as (select fn_id, fn_id, []::bigint[] from functions_v where name = 'f1'
      union select origin, e.dst, case kind when 'call' then list_append(stack, site) when 'return' then list_slice(stack, 1, len(stack) - 1) else stack end
      from r join e on e.src = r.node where kind <> 'return' or (len(stack) > 0 and stack[-1] = site))
    select distinct origin, node from r where len(stack) = 0""",
)
def gr09_whole(t):
    """Calls to the parent type, a step aside in it, and returns to the very site: what is reached with an empty stack, on paths of any length."""
    p = F.col("p_partkey")
    calls = t.part.filter("p_partkey >= 3").select(p.alias("src"), F.floor(p / 3).alias("dst"), F.lit("call").alias("kind"), p.alias("site"))
    exits = calls.select("src", F.explode(F.array(F.col("dst"), F.col("dst") + 1)).alias("at"), "site")
    returns = exits.select(F.col("at").alias("src"), F.col("src").alias("dst"), F.lit("return").alias("kind"), "site")
    aside = t.part.filter("p_partkey % 3 = 0").select(p.alias("src"), (p + 1).alias("dst"), F.lit("cfg").alias("kind"), F.lit(None).cast("long").alias("site"))
    seeds = t.functions_v.filter("name = 'f1'").select(F.col("fn_id").alias("origin"), F.col("fn_id").alias("node"))
    return op.context_balanced(calls.union(returns).union(aside), seeds)


TYPES = "select p_partkey as type, p_partkey // 3 as parent from part where p_partkey >= 3"


@query(
    "gr17_dispatch_within",
    """with m as (select distinct fn_id as type, name from functions_v), c as (select k_order, k_line, k_part, k_supp, k_price, callee as name, k_part as t0, k_part // 3 as t1, k_part // 9 as t2 from calls_v)
    select k_order, k_line, k_part, k_supp, k_price, case when m0.type is not null then t0 when m1.type is not null then t1 when m2.type is not null then t2 end as owner
    from c left join m m0 on m0.type = t0 and m0.name = 'f' || (k_part % 50 + k_line % 2) left join m m1 on k_part >= 3 and m1.type = t1 and m1.name = 'f' || (k_part % 50 + k_line % 2) left join m m2 on k_part // 3 >= 3 and m2.type = t2 and m2.name = 'f' || (k_part % 50 + k_line % 2)""",
)
def gr17(t):
    """Three levels of GR17: the nearest type upwards that declares the called name; part numbers stand for types, a third of one for its parent."""
    key = ["k_order", "k_line", "k_part", "k_supp", "k_price"]
    name = F.concat(F.lit("f"), (F.col("k_part") % 50 + F.col("k_line") % 2).cast("string"))
    calls = t.calls_v.select(F.struct(*key).alias("call_id"), F.col("k_part").alias("type"), name.alias("name"))
    methods = t.functions_v.select(F.col("fn_id").alias("type"), "name").distinct()
    parents = t.part.filter("p_partkey >= 3").select(F.col("p_partkey").alias("type"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    found = op.dispatch(calls, methods, parents, 2)
    rows = calls.select("call_id").join(found, "call_id", "left")
    return rows.select("call_id.*", "owner")


UP = "up(sub, anc, d) as (select p_partkey, p_partkey, 0 from part union all select sub, anc // 3, d + 1 from up where anc >= 3)"
WANTED = "w as (select distinct k_part as type, 'f' || (k_part % 50 + k_line % 2) as name from calls_v)"


def _hierarchy(t):
    methods = t.functions_v.select(F.col("fn_id").alias("type"), "name").distinct()
    parents = t.part.filter("p_partkey >= 3").select(F.col("p_partkey").alias("type"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    name = F.concat(F.lit("f"), (F.col("k_part") % 50 + F.col("k_line") % 2).cast("string"))
    return t.calls_v.withColumns({"type": F.col("k_part"), "name": name}), methods, parents


@query(
    "gr17_dispatch",
    f"""with recursive {UP}, {WANTED}, o as (select w.type, w.name, arg_min(anc, d) as owner from w join up on sub = w.type join functions_v f on f.fn_id = anc and f.name = w.name group by 1, 2)
    select k_order, k_line, k_part, k_supp, k_price, owner from calls_v left join o on o.type = k_part and o.name = 'f' || (k_part % 50 + k_line % 2)""",
)
def gr17_all(t):
    """The nearest declaring type at any height."""
    calls, methods, parents = _hierarchy(t)
    return calls.join(op.dispatch_all(calls, methods, parents), ["type", "name"], "left").select("k_order", "k_line", "k_part", "k_supp", "k_price", "owner")


@query(
    "gr17_cha_targets",
    f"""with recursive {UP}, {WANTED}, o as (select b.anc as type, w.name, b.sub, arg_min(a.anc, a.d) as owner from w join up b on b.anc = w.type join up a on a.sub = b.sub join functions_v f on f.fn_id = a.anc and f.name = w.name group by 1, 2, 3)
    select distinct type, name, owner from o""",
)
def gr17_cha(t):
    """The targets of each called name over all subtypes of the declared type."""
    return op.dispatch_targets(*_hierarchy(t))


@query("gr15_scope_closure", """with recursive r(origin, node) as (select n_nationkey, n_nationkey from nation union select origin, n2.n_nationkey from r join nation n1 on n1.n_nationkey = node join nation n2 on n2.n_nationkey = (n1.n_nationkey * 3 + n1.n_regionkey) % 25)
    select origin, node from r""")
def gr15(t):
    from lodestone.operators import graph

    key = F.col("n_nationkey")
    edges = t.nation.select(key.alias("src"), ((key * 3 + F.col("n_regionkey")) % 25).alias("dst"))
    return graph.reach(edges, t.nation.select(key.alias("origin"), key.alias("node"))).select("origin", "node")


@query("gr26_module_membership", "with m as (select distinct regexp_extract(file_path, '^(src/m[0-9])', 1) as module from functions_v) select distinct f.file_path, arg_max(module, length(module)) over (partition by f.file_path) as module from (select distinct file_path from functions_v) f join m on starts_with(f.file_path, module)")
def gr26(t):
    """The longest module path that is a prefix of the file's: prefixes of a path are exploded, then an equi-join."""
    modules = t.functions_v.select(F.regexp_extract("file_path", "^(src/m[0-9])", 1).alias("module")).distinct()
    files = t.functions_v.select("file_path").distinct()
    prefixes = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.length("file_path")), lambda n: F.substring(F.col("file_path"), F.lit(1), n))).alias("module"))
    best = prefixes.join(modules, "module").groupBy("file_path").agg(F.max(F.struct(F.length("module").alias("n"), "module")).alias("b"))
    return best.select("file_path", "b.module")


@query(
    "jn03_place_score",
    f"""with s as (select c.k_order, c.k_line, c.k_part, c.k_supp, c.k_price, f.fn_id, case when f.file_path = c.file_path then 2 else 0 end + case when f.line_start < c.line then 1 else 0 end as score
      from calls_v c join functions_v f on f.name = c.callee),
    m as (select k_order, k_line, k_part, k_supp, k_price, max(score) as top from s group by all)
    select s.k_order, s.k_line, s.k_part, s.k_supp, s.k_price, case when count(distinct fn_id) = 1 then min(fn_id) end as fn_id from s join m using (k_order, k_line, k_part, k_supp, k_price) where score = top group by all""",
)
def jn03(t):
    """The candidate of the greatest score, if it is the only one.  Calls are alike by (name, file, line), so each such place is resolved once."""
    places = t.calls_v.select("callee", "file_path", "line").distinct()
    candidates = t.functions_v.select(F.col("name").alias("callee"), "fn_id", F.col("file_path").alias("owner"), "line_start")
    score = F.when(F.col("owner") == F.col("file_path"), 2).otherwise(0) + F.when(F.col("line_start") < F.col("line"), 1).otherwise(0)
    scored = places.join(candidates, "callee").groupBy("callee", "file_path", "line", score.alias("score")).agg(F.count_distinct("fn_id").alias("n"), F.min("fn_id").alias("one"))
    best = scored.groupBy("callee", "file_path", "line").agg(F.max(F.struct("score", "n", "one")).alias("b"))
    resolved = best.select("callee", "file_path", "line", F.when(F.col("b.n") == 1, F.col("b.one")).alias("fn_id"))
    return t.calls_v.join(resolved, ["callee", "file_path", "line"]).select("k_order", "k_line", "k_part", "k_supp", "k_price", "fn_id")


@query("jn04_import_aliases", "with a as (select fn_id, unnest([qualified_name, regexp_replace(qualified_name, '^[^.]*[.]', ''), replace(qualified_name, '.', '/')]) as alias from functions_v) select p_partkey, count(fn_id) as candidates, case when count(fn_id) = 1 then min(fn_id) end as fn_id from part left join a on alias = case when p_partkey % 2 = 0 then 'm' || (p_partkey % 20) || '.f' || p_partkey else 'pkg/m' || (p_partkey % 20) || '/f' || p_partkey end group by 1")
def jn04(t):
    q = F.col("qualified_name")
    aliases = t.functions_v.select("fn_id", F.explode(F.array(q, F.regexp_replace(q, "^[^.]*[.]", ""), F.replace(q, F.lit("."), F.lit("/")))).alias("alias"))
    n, m = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 20).cast("string")
    wanted = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("m"), m, F.lit(".f"), n)).otherwise(F.concat(F.lit("pkg/m"), m, F.lit("/f"), n))
    rows = t.part.select("p_partkey", wanted.alias("alias")).join(aliases, "alias", "left")
    return rows.groupBy("p_partkey").agg(F.count("fn_id").alias("candidates"), F.when(F.count("fn_id") == 1, F.min("fn_id")).alias("fn_id"))


@query(
    "jn19_labels_in_reach",
    """with l as (select distinct rule_id || file_path as k, line_start as at from findings_v where severity = 'critical' and confidence > 0.97), p as (select distinct rule_id || file_path as k, line_start + 2 as at from findings_v where severity = 'critical' and confidence < 0.25)
    select l.k, count(*) as labels, count(*) filter (exists (select 1 from p where p.k = l.k and abs(p.at - l.at) <= 3)) as near from l group by 1""",
)
def jn19(t):
    """Labels with a prediction within three lines: an equi-join on the lines that a label may be met at."""
    rows = t.findings_v.filter("severity = 'critical'").withColumn("k", F.concat("rule_id", "file_path"))
    labels = rows.filter("confidence > 0.97").select("k", F.col("line_start").alias("at")).distinct()
    found = rows.filter("confidence < 0.25").select("k", (F.col("line_start") + 2).alias("hit")).distinct()
    wide = labels.withColumn("hit", F.explode(F.sequence(F.col("at") - 3, F.col("at") + 3)))
    near = wide.join(found, ["k", "hit"], "left_semi").select("k", "at").distinct().withColumn("near", F.lit(1))
    return labels.join(near, ["k", "at"], "left").groupBy("k").agg(F.count(F.lit(1)).alias("labels"), F.count("near").alias("near"))


@query(
    "jn25_bean_selection",
    """with c as (select p_brand as type, p_partkey, p_size % 5 = 0 as is_primary, p_type as qualifier from part), w as (select s_suppkey, 'Brand#' || (s_suppkey % 60) as type from supplier)
    select s_suppkey, count(p_partkey) as candidates, case when count(p_partkey) = 0 then 'none' when count(p_partkey) = 1 then 'single' when count(*) filter (is_primary) = 1 then 'primary' else 'ambiguous' end as how from w left join c using (type) group by 1""",
)
def jn25(t):
    beans = t.part.groupBy(F.col("p_brand").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") % 5 == 0).alias("primaries"))
    wanted = t.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("type"))
    n = F.coalesce("n", F.lit(0))
    how = F.when(n == 0, "none").when(n == 1, "single").when(F.col("primaries") == 1, "primary").otherwise("ambiguous")
    return wanted.join(beans, "type", "left").select("s_suppkey", n.alias("candidates"), how.alias("how"))


@query("rl05_absent_before", "select doc_id, line from (select doc_id, line, code, coalesce(max(case when contains(code, 'with') then 1 else 0 end) over (partition by doc_id order by line rows between 3 preceding and 1 preceding), 0) as guarded from source_lines_v) where contains(code, ' of ') and guarded = 0")
def rl05(t):
    """A line whose window before it lacks the guard."""
    return rules.absent_before(t.source_lines_v, "doc_id", "line", F.contains("code", F.lit(" of ")), F.contains("code", F.lit("with")), 3)


@query("rl15_by_names", f"select fn_id, round(0.8 * case when exists (select 1 from edges_v where dst = fn_id and overlay = 'call' and src in (select fn_id from functions_v where name = 'f9')) then 0.6 else 1 end, 6) as confidence from functions_v where name in ('f1', 'f2', 'f3')")
def rl15(t):
    """Endpoint functions without an ownership check; a direct caller that authenticates scales the confidence."""
    guards = t.functions_v.filter("name = 'f9'").select(F.col("fn_id").alias("src"))
    guarded = t.edges_v.filter("overlay = 'call'").join(guards, "src", "left_semi").select(F.col("dst").alias("fn_id")).distinct().withColumn("g", F.lit(0.6))
    rows = t.functions_v.filter(F.col("name").isin("f1", "f2", "f3")).join(guarded, "fn_id", "left")
    return rows.select("fn_id", F.round(0.8 * F.coalesce("g", F.lit(1.0)), 6).alias("confidence"))


@query("tn11_defence_context", "with auth as (select distinct e.dst as fn_id from edges_v e join functions_v f on e.src = f.fn_id where f.name = 'f9' and overlay = 'call') select f.fn_id, case when f.name = 'f9' then 'decorator' when a.fn_id is not null then 'ancestor' when f.qualified_name like '%.f9%' then 'call' end as defence from functions_v f left join auth a on a.fn_id = f.fn_id")
def tn11(t):
    auth = t.edges_v.filter("overlay = 'call'").join(t.functions_v.filter("name = 'f9'").select(F.col("fn_id").alias("src")), "src", "left_semi")
    auth = auth.select(F.col("dst").alias("fn_id")).distinct().withColumn("a", F.lit(True))
    how = F.when(F.col("name") == "f9", "decorator").when(F.col("a"), "ancestor").when(F.contains("qualified_name", F.lit(".f9")), "call")
    return t.functions_v.join(auth, "fn_id", "left").select("fn_id", how.alias("defence"))


@query("tn14_props", "select event_id, case when json_extract(props, '$.k') is null then 'missing' when json_extract(props, '$.k')::bigint % 3 = 0 then 'true' when json_extract(props, '$.k')::bigint % 3 = 1 then 'false' else 'unknown' end as state from events")
def tn14(t):
    k = F.get_json_object("props", "$.k").cast("long")
    state = F.when(k.isNull(), "missing").when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("unknown")
    return t.events.select("event_id", state.alias("state"))


@query("flt11_all_blocking", "select scan_id, line_start from findings_v group by 1, 2 having not bool_and(disposition = 'blocking')")
def flt11(t):
    """A flow goes only if all sink calls on its line are harmless."""
    return t.findings_v.groupBy("scan_id", "line_start").agg(F.bool_and(F.col("disposition") == "blocking").alias("all_")).filter("not all_").drop("all_")


@query("flt17_citations", "select f.scan_id, f.k_line, f.k_part, f.k_supp, f.k_price, sha256(f.message) = sha256('unsafe call at line ' || ((f.k_part * 7) % 400 + case when f.k_part % 9 = 0 then 2 else 1 end)) as valid from findings_v f")
def flt17(t):
    """A claim counts if the digest of the excerpt, derived again, equals the claimed one."""
    claimed = F.sha2("message", 256)
    line = (F.col("k_part") * 7) % 400 + F.when(F.col("k_part") % 9 == 0, 2).otherwise(1)
    derived = F.sha2(F.concat(F.lit("unsafe call at line "), line.cast("string")), 256)
    return t.findings_v.select("scan_id", "k_line", "k_part", "k_supp", "k_price", (claimed == derived).alias("valid"))


@query("ag21_token_usage", "select role, sum(n_chars)::bigint as reported, count(*) filter (n_chars is null) as unknown, max(n_chars)::bigint as most, bool_and(n_chars >= 0) as sound from turns_v group by 1")
def ag21(t):
    n = F.col("n_chars")
    return t.turns_v.groupBy("role").agg(F.sum(n).alias("reported"), F.count_if(n.isNull()).alias("unknown"), F.max(n).cast("long").alias("most"), F.bool_and(n >= 0).alias("sound"))


@query("ag22_rule_audit", "select count(*) as rules, count(*) filter (n > 1) as duplicated, sum(n)::bigint as patterns, max(n) as most from (select p_name, count(*) as n from part group by 1)")
def ag22(t):
    n = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("n") > 1).alias("duplicated"), F.sum("n").alias("patterns"), F.max("n").alias("most"))


@query("ag25_run_finalisation", "select conv_id, case when bool_or(n_chars > 900) then 'partial' when bool_or(role = 'user' and n_chars > 600) then 'waiting' else 'completed' end as status from turns_v group by 1")
def ag25(t):
    state = F.when(F.bool_or(F.col("n_chars") > 900), "partial").when(F.bool_or((F.col("role") == "user") & (F.col("n_chars") > 600)), "waiting").otherwise("completed")
    return t.turns_v.groupBy("conv_id").agg(state.alias("status"))


@query("lc07_absence", "with last as (select project_id, max(created_at) as complete_at from scans_v where status = 'completed' group by 1), f as (select s.project_id, f.rule_id, max(s.created_at) as seen from findings_v f join scans_v s using (scan_id) group by 1, 2) select project_id, rule_id, seen < complete_at as absent from f join last using (project_id)")
def lc07(t):
    """An identity is absent once a complete scan came after the last one that saw it."""
    last = t.scans_v.filter("status = 'completed'").groupBy("project_id").agg(F.max("created_at").alias("at"))
    seen = t.findings_v.select("scan_id", "rule_id").join(t.scans_v.select("scan_id", "project_id", "created_at"), "scan_id").groupBy("project_id", "rule_id").agg(F.max("created_at").alias("seen"))
    return seen.join(last, "project_id").select("project_id", "rule_id", (F.col("seen") < F.col("at")).alias("absent"))


@query("lc11_ranges", "select p_partkey, case when p_size < 5 then 'not_affected' when p_size between 5 and 20 and p_retailprice > 950 then 'affected' when p_retailprice is null then 'unknown' else 'review' end as verdict from part")
def lc11(t):
    verdict = F.when(F.col("p_size") < 5, "not_affected").when(F.col("p_size").between(5, 20) & (F.col("p_retailprice") > 950), "affected").when(F.col("p_retailprice").isNull(), "unknown").otherwise("review")
    return t.part.select("p_partkey", verdict.alias("verdict"))


@query("lc12_trace", "with f as (select f.scan_id, f.k_line, f.k_part, f.k_supp, f.k_price, min(e.src) as caller from findings_v f left join edges_v e on e.dst = f.k_part and e.overlay = 'call' group by all) select f.scan_id, f.k_line, f.k_part, f.k_supp, f.k_price, g.qualified_name || coalesce(' <- ' || h.qualified_name, '') as trace from f join functions_v g on g.fn_id = k_part left join functions_v h on h.fn_id = caller")
def lc12(t):
    callers = t.edges_v.filter("overlay = 'call'").groupBy(F.col("dst").alias("k_part")).agg(F.min("src").alias("caller"))
    names = t.functions_v.select("fn_id", "qualified_name")
    steps = callers.join(names.toDF("caller", "h"), "caller", "left").select("k_part", "h")
    traced = names.toDF("k_part", "g").join(steps, "k_part", "left").select("k_part", F.concat("g", F.coalesce(F.concat(F.lit(" <- "), "h"), F.lit(""))).alias("trace"))
    return t.findings_v.join(traced, "k_part").select("scan_id", "k_line", "k_part", "k_supp", "k_price", "trace")


@query("sm02_lease_fencing", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as fence, ts + interval 120 second > lead(ts) over (partition by user_id order by ts, event_id) as held from events")
def sm02(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    held = F.col("ts") + F.expr("interval 120 seconds") > F.lead("ts").over(w)
    return t.events.select("event_id", "user_id", F.row_number().over(w).alias("fence"), held.alias("held"))


@query("fn06_joined_names", "select page_id, regexp_replace('/api/' || repository_id || '/' || path, '/+', '/', 'g') as route from endpoints_v")
def fn06(t):
    return t.endpoints_v.select("page_id", F.regexp_replace(F.concat(F.lit("/api/"), "repository_id", F.lit("/"), "path"), "/+", "/").alias("route"))


@query("fn08_bare_types", "select p_partkey, lower(trim(regexp_replace(regexp_replace('List<' || p_type || '>[]', '<[^>]*>', '', 'g'), '[^A-Za-z ]', '', 'g'))) as bare from part")
def fn08(t):
    full = F.concat(F.lit("List<"), "p_type", F.lit(">[]"))
    return t.part.select("p_partkey", F.lower(F.trim(F.regexp_replace(F.regexp_replace(full, "<[^>]*>", ""), "[^A-Za-z ]", ""))).alias("bare"))


@query("fn25_plain_json", """select event_id, sha256('{"id":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}') as digest from events""")
def fn25(t):
    """Keys sorted, no blanks."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return t.events.select("event_id", F.sha2(body, 256).alias("digest"))


@query("fn24_framed_digest", "select conv_id, sha256(string_agg(length(role) || ':' || role || n_chars || ';', '' order by turn)) as digest from turns_v group by 1")
def fn24(t):
    """Length-prefixed frames, so that no two sequences share a digest by chance of their joints."""
    frame = F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.col("n_chars").cast("string"), F.lit(";"))
    return joined_sha256(t.turns_v, "conv_id", ["turn"], frame)


@query("fn30_verdict_binding", "with v as (select conv_id, n_chars % 6 as i from turns_v) select conv_id, case when count(*) = count(distinct i) and max(i) < count(*) then 'bound' else 'rejected' end as batch from v group by 1")
def fn30(t):
    """Verdicts refer to findings by index; a repeated index or one out of range voids the batch."""
    i = F.col("n_chars") % 6
    fits = (F.count(F.lit(1)) == F.count_distinct(i)) & (F.max(i) < F.count(F.lit(1)))
    return t.turns_v.groupBy("conv_id").agg(F.when(fits, "bound").otherwise("rejected").alias("batch"))


@query(
    "jn19_interval_matching",
    """with recursive p as (select rule_id, file_path, line_start as at, row_number() over (partition by rule_id, file_path order by line_start) as i from findings_v where severity = 'critical' and confidence > 0.6),
    l as (select rule_id, file_path, line_start + k_line % 5 as at, row_number() over (partition by rule_id, file_path order by line_start + k_line % 5) as j from findings_v where severity = 'critical' and confidence < 0.5),
    r(rule_id, file_path, i, j, hits) as (select distinct rule_id, file_path, 1::bigint, 1::bigint, 0::bigint from p
      union all select r.rule_id, r.file_path, case when l.at < p.at - 3 then i else i + 1 end, case when l.at <= p.at + 3 then j + 1 else j end, case when l.at between p.at - 3 and p.at + 3 then hits + 1 else hits end
      from r join p using (rule_id, file_path, i) join l using (rule_id, file_path, j)),
    best as (select rule_id, sum(hits)::bigint as tp from (select rule_id, file_path, max(hits) as hits from r group by 1, 2) group by 1)
    select coalesce(a.rule_id, e.rule_id) as rule_id, coalesce(tp, 0)::bigint as tp, coalesce(a.n, 0) - coalesce(tp, 0)::bigint as fp, coalesce(e.n, 0) - coalesce(tp, 0)::bigint as fn
    from (select rule_id, count(*) as n from p group by 1) a full join (select rule_id, count(*) as n from l group by 1) e using (rule_id) left join best on best.rule_id = coalesce(a.rule_id, e.rule_id)""",
)
def jn19_matching(t):
    """Findings against labels within three lines, as many as can be matched one to one; counts for each rule."""
    rows = t.findings_v.filter("severity = 'critical'")
    labels = rows.filter("confidence < 0.5").withColumn("line_start", F.col("line_start") + F.col("k_line") % 5)
    found = joins.matched_lines(rows.filter("confidence > 0.6"), labels, ["rule_id", "file_path"], "line_start")
    tp, given, wanted = (F.sum(c) for c in ("actual_matched", "actual", "expected"))
    return found.groupBy("rule_id").agg(tp.alias("tp"), (given - tp).alias("fp"), (wanted - tp).alias("fn"))


@query(
    "gr16_virtual_methods",
    """with recursive c as (select a.p_partkey as type, b.p_partkey as super, case when a.p_partkey % 4 = 1 then 100000 + a.p_partkey % 10 end as iface from part a left join part b on b.p_partkey = a.p_partkey // 3 and b.p_partkey <> a.p_partkey),
    m as (select p_partkey as type, 'm' || (p_partkey % 5) as name, case when p_partkey % 3 = 0 then 'abstract' when p_partkey % 7 = 0 then 'static' else 'concrete' end as kind from part where p_size % 2 = 0
      union all select 100000 + i, 'm' || (i % 5), case when i % 4 = 0 then 'abstract' else 'default' end from range(10) r(i)),
    ie(type, parent) as (select 100000 + i, 100000 + (i + 3) % 10 from range(10) r(i) where i % 2 = 0), w as (select distinct p_partkey as type, 'm' || (p_size % 5) as name from part),
    up(type, anc, d) as (select p_partkey, p_partkey, 0 from part union all select up.type, c.super, d + 1 from up join c on c.type = up.anc where c.super is not null),
    stop as (select w.type, w.name, min(d) as d from w join up on up.type = w.type join m on m.type = anc and m.name = w.name group by 1, 2),
    own as (select s.type, s.name, anc as target from stop s join up on up.type = s.type and up.d = s.d join m on m.type = anc and m.name = s.name where m.kind = 'concrete'),
    below as (select w.type, w.name, anc, up.d from w join up on up.type = w.type left join stop s on s.type = w.type and s.name = w.name left join own o on o.type = w.type and o.name = w.name where (s.d is null or up.d < s.d) and o.type is null),
    fi(type, name, d, place) as (select b.type, b.name, b.d, iface from below b join c on c.type = b.anc where iface is not null union select fi.type, fi.name, fi.d, ie.parent from fi join ie on ie.type = fi.place left join m on m.type = fi.place and m.name = fi.name where m.type is null),
    df as (select fi.type, fi.name, fi.d, place as target from fi join m on m.type = place and m.name = fi.name where m.kind = 'default')
    select type, name, target from own union select type, name, target from df join (select type, name, max(d) as d from df group by type, name) using (type, name, d)""",
)
def gr16(t):
    """The superclass chain first, nothing for abstract and static ones, interface defaults of the classes below the declaring one last."""
    p, text = F.col("p_partkey"), lambda a, c: F.concat(F.lit(a), c.cast("string"))
    faces = t.spark.range(10).select(F.col("id").alias("i"))
    kind = F.when(p % 3 == 0, "abstract").when(p % 7 == 0, "static").otherwise("concrete")
    methods = t.part.filter("p_size % 2 = 0").select(p.alias("type"), text("m", p % 5).alias("name"), kind.alias("kind"))
    methods = methods.union(faces.select(F.col("i") + 100000, text("m", F.col("i") % 5), F.when(F.col("i") % 4 == 0, "abstract").otherwise("default")))
    supers = t.part.select(p.alias("type"), F.floor(p / 3).alias("parent")).join(t.part.select(p.alias("parent")), "parent").select("type", "parent")
    interfaces = t.part.filter("p_partkey % 4 = 1").select(p.alias("type"), (100000 + p % 10).alias("parent"))
    extends = faces.filter("i % 2 = 0").select((F.col("i") + 100000).alias("type"), (100000 + (F.col("i") + 3) % 10).alias("parent"))
    return op.virtual_targets(t.part.select(p.alias("type"), text("m", F.col("p_size") % 5).alias("name")), methods, supers, interfaces.union(extends))
