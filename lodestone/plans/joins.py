"""Queries that resolve calls, lines, spans and identities by joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import joins as op
from lodestone.operators.findings import running_sum
from lodestone.plans.registry import query

CALL = ["k_order", "k_line", "k_part", "k_supp", "k_price"]
C = ", ".join(CALL)


@query("jn01_import_binding", f"select {C}, callee, count(fn_id) as bindings from calls_v c left join functions_v f on c.callee = f.name and c.file_path = f.file_path group by all")
def jn01(t):
    n = t.functions_v.groupBy(F.col("name").alias("callee"), "file_path").agg(F.count(F.lit(1)).alias("bindings"))
    return t.calls_v.join(n, ["callee", "file_path"], "left").select(*CALL, "callee", F.coalesce("bindings", F.lit(0)).alias("bindings"))


@query(
    "jn02_two_tiers",
    f"""with local as (select name, file_path, count(distinct fn_id) as n, min(fn_id) as id from functions_v group by 1, 2),
    everywhere as (select name, count(distinct fn_id) as n, min(fn_id) as id from functions_v group by 1)
    select {C}, case when l.n is not null then 'local' when g.n is not null then 'global' end as tier,
      case when l.n is not null then (case when l.n = 1 then l.id end) when g.n = 1 then g.id end as fn_id
    from calls_v c left join local l on c.callee = l.name and c.file_path = l.file_path left join everywhere g on c.callee = g.name""",
)
def jn02(t):
    names = t.functions_v.select(F.col("name").alias("callee"), "file_path", "fn_id")
    found = op.tiered(t.calls_v, [("local", names, ["callee", "file_path"]), ("global", names, ["callee"])], "fn_id")
    return found.select(*CALL, "tier", "fn_id")


@query(
    "jn05_suffix_index",
    """select suffix, fn_id from (select fn_id, qualified_name as suffix from functions_v union all select fn_id, regexp_replace(qualified_name, '^[^.]*[.]', '') from functions_v
    union all select fn_id, regexp_replace(qualified_name, '^[^.]*[.][^.]*[.]', '') from functions_v)""",
)
def jn05(t):
    parts = F.split("qualified_name", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return t.functions_v.select(F.explode(suffixes).alias("suffix"), "fn_id")


@query(
    "jn06_enclosing_function",
    f"""select {C}, line, arg_min(fn_id, (f.line_end - f.line_start, fn_id)) as fn_id
    from calls_v c left join functions_v f on c.file_path = f.file_path and c.line between f.line_start and f.line_end group by all""",
)
def jn06(t):
    return op.containing(t.calls_v, t.functions_v, "file_path", "line", ["fn_id"]).select(*CALL, "line", "fn_id")


@query(
    "jn09_nearest_statement",
    f"""with p as (select distinct file_path, line from calls_v), m as (select p.file_path, p.line, arg_min(struct_pack(id := fn_id, d := abs(p.line - f.line_start)), (abs(p.line - f.line_start), f.line_start, fn_id)) as b
      from p join functions_v f on p.file_path = f.file_path group by 1, 2)
    select {C}, b.id as fn_id, b.d as distance from calls_v c left join m using (file_path, line)""",
)
def jn09(t):
    found = op.nearest(t.calls_v, t.functions_v.withColumnRenamed("line_start", "at"), "file_path", "line", "at", "fn_id")
    return found.select(*CALL, "fn_id", "distance")


@query(
    "jn10_finding_endpoint",
    """with p as (select distinct file_path, line_start from findings_v),
    inside as (select p.file_path, p.line_start, arg_min(fn_id, (f.line_end - f.line_start, fn_id)) as fn_id from p join functions_v f on p.file_path = f.file_path and p.line_start between f.line_start and f.line_end group by 1, 2),
    near as (select p.file_path, p.line_start, arg_min(fn_id, (abs(p.line_start - f.line_start), f.line_start, fn_id)) as fn_id from p join functions_v f on p.file_path = f.file_path group by 1, 2)
    select p.file_path, p.line_start, coalesce(i.fn_id, n.fn_id) as fn_id, i.fn_id is not null as contained from p left join inside i using (file_path, line_start) left join near n using (file_path, line_start)""",
)
def jn10(t):
    points = t.findings_v.select("file_path", "line_start").distinct()
    asked = points.withColumnRenamed("line_start", "line")
    inside = op.containing(asked, t.functions_v, "file_path", "line", ["fn_id"]).withColumnRenamed("fn_id", "inner")
    near = op.nearest(inside, t.functions_v.withColumnRenamed("line_start", "at"), "file_path", "line", "at", "fn_id")
    return near.select("file_path", F.col("line").alias("line_start"), F.coalesce("inner", "fn_id").alias("fn_id"), F.col("inner").isNotNull().alias("contained"))


@query(
    "jn11_overlaps",
    """select rule_id, f.file_path, f.line_start, f.line_end, fn_id from (select distinct rule_id, file_path, line_start, line_end from findings_v) f
    join functions_v g on f.file_path = g.file_path and f.line_start <= g.line_end and g.line_start <= f.line_end""",
)
def jn11(t):
    spans = t.findings_v.select("rule_id", "file_path", "line_start", "line_end").distinct()
    functions = t.functions_v.select("file_path", "fn_id", F.col("line_start").alias("r_start"), F.col("line_end").alias("r_end"))
    return op.overlapping(spans, functions, "file_path").select("rule_id", "file_path", "line_start", "line_end", "fn_id")


@query("jn15_parent_spans", "select c.event_id, p.event_id as parent, c.trace_id from observations_v c join observations_v p on c.parent_event_id = p.event_id and p.status_code = 200")
def jn15(t):
    known = t.observations_v.filter("status_code = 200").select(F.col("event_id").alias("parent"))
    return t.observations_v.join(known, F.col("parent_event_id") == F.col("parent")).select("event_id", "parent", "trace_id")


@query("jn16_suppressed_edges", "select src, dst from edges_v a where overlay = 'semantic' and not exists (select 1 from edges_v b where b.overlay = 'call' and b.src = a.src and b.dst % 10 = a.dst % 10)")
def jn16(t):
    """Imprecise edges go where a precise one leaves the same site."""
    precise = t.edges_v.filter("overlay = 'call'").select("src", (F.col("dst") % 10).alias("site")).distinct()
    return t.edges_v.filter("overlay = 'semantic'").withColumn("site", F.col("dst") % 10).join(precise, ["src", "site"], "left_anti").select("src", "dst")


@query("jn17_added_endpoints", "select distinct method, path from routes_v r where not exists (select 1 from endpoints_v e where e.path = r.path and e.method = r.method)")
def jn17(t):
    return t.routes_v.select("method", "path").distinct().join(t.endpoints_v.select("method", "path").distinct(), ["method", "path"], "left_anti")


@query(
    "jn18_retired",
    """with old as (select distinct file_path, rule_id, line_start from findings_v join scans_v using (scan_id) where branch = 'dev'),
    new as (select distinct file_path, rule_id, line_start from findings_v join scans_v using (scan_id) where branch = 'main')
    select file_path, rule_id, line_start from old where (file_path, rule_id) in (select (file_path, rule_id) from new) and (file_path, rule_id, line_start) not in (select (file_path, rule_id, line_start) from new)""",
)
def jn18(t):
    """Identities absent from the new scan, within rules and files that it evaluated."""
    rows = t.findings_v.join(t.scans_v.select("scan_id", "branch"), "scan_id")
    keys = ["file_path", "rule_id", "line_start"]
    old, new = (rows.filter(F.col("branch") == b).select(*keys).distinct() for b in ("dev", "main"))
    return old.join(new.select("file_path", "rule_id").distinct(), ["file_path", "rule_id"], "left_semi").join(new, keys, "left_anti").select(*keys)


@query("jn22_artifact_resolution", """with pub as (select name, count(distinct file_path) as n, min(file_path) as one from functions_v group by 1)
    select distinct c.callee, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as status, case when n = 1 then one end as publisher from calls_v c left join pub on c.callee = pub.name""")
def jn22(t):
    published = op.unique_targets(t.functions_v.withColumnRenamed("name", "callee"), ["callee"], "file_path", "publisher")
    status = F.when(F.col("publisher_n").isNull(), "unresolved").when(F.col("publisher_n") == 1, "resolved").otherwise("ambiguous")
    return t.calls_v.select("callee").distinct().join(published, "callee", "left").select("callee", status.alias("status"), "publisher")


@query("jn23_version_conflicts", "with v as (select distinct p_brand as family, p_size as version from part) select a.family, a.version as left_version, b.version as right_version from v a join v b on a.family = b.family and a.version <> b.version")
def jn23(t):
    """All ordered pairs are the result; a family's distinct versions are few, as they are counted once each."""
    versions = t.part.select(F.col("p_brand").alias("family"), F.col("p_size").alias("version")).distinct()
    sets = versions.groupBy("family").agg(F.collect_set("version").alias("others"))
    pairs = versions.join(sets, "family").select("family", F.col("version").alias("left_version"), F.explode("others").alias("right_version"))
    return pairs.filter("left_version != right_version")


@query("jn27_edge_endpoints", "select e.src, e.dst, f.name as src_name, g.name as dst_name from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id where overlay = 'call' and g.line_end < 400")
def jn27(t):
    names = t.functions_v.select("fn_id", "name", "line_end")
    left = t.edges_v.filter("overlay = 'call'").join(names.select(F.col("fn_id").alias("src"), F.col("name").alias("src_name")), "src")
    return left.join(names.filter("line_end < 400").select(F.col("fn_id").alias("dst"), F.col("name").alias("dst_name")), "dst").select("src", "dst", "src_name", "dst_name")


@query("jn28_nested_evidence", "select page_id, count(raw_url) as links, coalesce(string_agg(raw_url, '|' order by ord), '') as evidence from endpoints_v left join client_calls_v using (page_id) group by 1")
def jn28(t):
    nested = t.client_calls_v.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "raw_url"))).alias("l"))
    rows = t.endpoints_v.select("page_id").join(nested, "page_id", "left")
    return rows.select("page_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.array_join("l.raw_url", "|"), F.lit("")).alias("evidence"))


@query(
    "jn29_contract_match",
    """with s as (select method, path, count(*) as n from endpoints_v group by 1, 2), c as (select distinct method, path from routes_v)
    select coalesce(c.method, s.method) as method, coalesce(c.path, s.path) as path, case when c.path is null then 'source_only' when s.path is null then 'spec_only' when n = 1 then 'exact_route' else 'ambiguous' end as status
    from c full join s on c.method = s.method and c.path = s.path""",
)
def jn29(t):
    source = t.endpoints_v.groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))
    spec = t.routes_v.select("method", "path").distinct().withColumn("spec", F.lit(True))
    status = F.when(F.col("spec").isNull(), "source_only").when(F.col("n").isNull(), "spec_only").when(F.col("n") == 1, "exact_route").otherwise("ambiguous")
    return spec.join(source, ["method", "path"], "full").select("method", "path", status.alias("status"))


@query(
    "jn30_one_to_one",
    """with p as (select distinct l_partkey as old_id, l_suppkey * 1000 + l_partkey % 37 as new_id from lineitem where l_quantity > 45)
    select old_id, new_id, case when count(*) over (partition by old_id) = 1 and count(*) over (partition by new_id) = 1 then 'matched' else 'review' end as status from p""",
)
def jn30(t):
    pairs = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("old_id"), (F.col("l_suppkey") * 1000 + F.col("l_partkey") % 37).alias("new_id"))
    return op.one_to_one(pairs, "old_id", "new_id")


@query("jn31_composite_join", "select p.project_id, s.scan_id, m.role from projects_v p join scans_v s on s.project_id = p.project_id and s.status = 'completed' join members_v m on m.project_id = p.project_id and m.role <> 'viewer' order by s.scan_id limit 50")
def jn31(t):
    """The first fifty are the feature."""
    rows = t.scans_v.filter("status = 'completed'").join(t.projects_v, "project_id").join(t.members_v.filter("role != 'viewer'"), "project_id")
    return rows.orderBy("scan_id").limit(50).select("project_id", "scan_id", "role")


@query(
    "jn32_related_files",
    """with e as (select distinct f.file_path as a, g.file_path as b from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id where overlay = 'semantic'),
    r as (select a, b from e union select b, a from e) select a as file_path, b as related from (select *, row_number() over (partition by a order by b) as n from r where a <> b) where n <= 150""",
)
def jn32(t):
    from lodestone.operators.findings import first_of

    files = t.functions_v.select("fn_id", "file_path")
    e = t.edges_v.filter("overlay = 'semantic'").join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst").select("a", "b").distinct()
    both = e.union(e.select("b", "a")).distinct().filter("a != b")
    return first_of(both, ["a"], ["b"], 150).toDF("file_path", "related")


@query(
    "jn33_read_before_write",
    """select distinct a.conv_id, a.turn as read_turn, b.turn as write_turn from turns_v a join turns_v b on a.conv_id = b.conv_id and b.turn > a.turn and b.turn - a.turn <= 3 and a.role = 'user' and b.role = 'assistant'
    where not exists (select 1 from turns_v x where x.conv_id = a.conv_id and x.turn > a.turn and x.turn < b.turn and x.n_chars < 60)""",
)
def jn33(t):
    """A read, then a write at most three places on, with no defence between.  The distance is an equi-join on the place."""
    turns = t.turns_v
    reads = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("read_turn"), F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + 3)).alias("write_turn"))
    pairs = reads.join(turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("write_turn")), ["conv_id", "write_turn"]).distinct()
    defence = turns.filter("n_chars < 60").select("conv_id", F.col("turn").alias("mid"))
    mids = pairs.filter("write_turn - read_turn > 1").withColumn("mid", F.explode(F.sequence(F.col("read_turn") + 1, F.col("write_turn") - 1)))
    safe = mids.join(defence, ["conv_id", "mid"], "left_semi").select("conv_id", "read_turn", "write_turn").distinct()
    return pairs.join(safe, ["conv_id", "read_turn", "write_turn"], "left_anti").select("conv_id", "read_turn", "write_turn")


@query("wn10_next_step", "select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as next_turn from turns_v")
def wn10(t):
    return t.turns_v.withColumn("next_turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "next_turn")


@query("wn11_path_complete", "select conv_id, bool_and(nxt is null or nxt = turn + 1) as complete, count(*) as steps from (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nxt from turns_v) group by 1")
def wn11(t):
    n = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    steps = t.turns_v.select("conv_id", "turn", n.alias("nxt"))
    return steps.groupBy("conv_id").agg(F.bool_and(F.col("nxt").isNull() | (F.col("nxt") == F.col("turn") + 1)).alias("complete"), F.count(F.lit(1)).alias("steps"))


@query("wn12_thread_flow", "select conv_id, lag(turn) over (partition by conv_id order by turn) as src, turn as dst, role from turns_v qualify src is not null")
def wn12(t):
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.turns_v.select("conv_id", before.alias("src"), F.col("turn").alias("dst"), "role").filter("src is not null")


@query(
    "wn13_share",
    """select conv_id, turn, round(sum(n_chars) over (partition by conv_id order by turn) / nullif(sum(n_chars) over (partition by conv_id), 0), 6) as done from turns_v""",
)
def wn13(t):
    totals = t.turns_v.groupBy(F.col("conv_id").alias("_of")).agg(F.sum("n_chars").alias("_all"))
    upto = running_sum(t.turns_v, ["conv_id"], "turn", 1024, F.col("n_chars"), "_upto")
    rows = upto.join(totals, F.col("conv_id").eqNullSafe(F.col("_of")))
    return rows.select("conv_id", "turn", F.round(F.col("_upto") / F.nullif(F.col("_all"), F.lit(0)), 6).alias("done"))


@query("wn14_budget", "select doc_id, line from (select doc_id, line, sum(length(code) + 1) over (partition by doc_id order by line) as used from source_lines_v) where used <= 2000")
def wn14(t):
    return running_sum(t.source_lines_v, ["doc_id"], "line", 1024, F.length("code") + 1, "used").filter("used <= 2000").select("doc_id", "line")


@query("wn15_retry_schedule", "select event_id, attempt, ts + to_seconds(5 * (power(2, attempt - 1))::bigint) as due from events, unnest([1, 2, 3]) a(attempt) where event_type = 'error'")
def wn15(t):
    attempts = t.events.filter("event_type = 'error'").withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return attempts.select("event_id", "attempt", F.expr("timestampadd(SECOND, CAST(5 * power(2, attempt - 1) AS int), ts)").alias("due"))
