"""Further queries: statements, cross-repository references, overlays, guards, options and record checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import graph, joins
from lodestone.operators.findings import first_of
from lodestone.plans.registry import query


@query(
    "jn07_occurrences",
    """with p as (select distinct file_path, line, callee from calls_v), b as (select p.file_path, p.line, p.callee, arg_min(fn_id, (f.line_end - f.line_start, fn_id)) as fn_id
      from p join functions_v f on p.file_path = f.file_path and p.line between f.line_start and f.line_end group by 1, 2, 3)
    select fn_id, callee as symbol, 'symbol-reference' as kind from b union select fn_id, 'f' || (fn_id % 50), 'symbol-definition' from functions_v union select distinct fn_id, callee, 'resolved-definition' from b where callee = 'f' || (fn_id % 50)""",
)
def jn07(t):
    """Occurrences inside the narrowest function become references; a function defines its own name."""
    places = t.calls_v.select("file_path", "line", "callee").distinct()
    inside = joins.containing(places, t.functions_v, "file_path", "line", ["fn_id"]).filter("fn_id is not null").select("fn_id", F.col("callee").alias("symbol"))
    own = t.functions_v.select("fn_id", F.col("name").alias("symbol"))
    kind = lambda df, name: df.distinct().withColumn("kind", F.lit(name))
    return kind(inside, "symbol-reference").union(kind(own, "symbol-definition")).union(kind(inside.join(own, ["fn_id", "symbol"], "left_semi"), "resolved-definition"))


@query(
    "jn08_statement_match",
    """with p as (select distinct file_path, line from calls_v) select p.file_path, p.line, arg_min(fn_id, (f.line_end - f.line_start, abs(p.line - f.line_start), length(f.qualified_name), fn_id)) as fn_id
    from p join functions_v f on p.file_path = f.file_path and p.line between f.line_start and f.line_end group by 1, 2""",
)
def jn08(t):
    """The narrowest statement; ties by distance, then by the length of its code, then by its id."""
    rows = t.calls_v.select("file_path", "line").distinct().withColumnRenamed("line", "r_start").withColumn("r_end", F.col("r_start"))
    met = joins.overlapping(t.functions_v, rows, "file_path")
    order = F.struct(F.col("line_end") - F.col("line_start"), F.abs(F.col("r_start") - F.col("line_start")), F.length("qualified_name"), F.col("fn_id").alias("id"))
    return met.groupBy("file_path", F.col("r_start").alias("line")).agg(F.min(order)["id"].alias("fn_id"))


@query(
    "jn24_cross_repository",
    """with s as (select name, file_path, min(fn_id) as fn_id, count(*) as n from functions_v group by 1, 2), g as (select name, count(distinct file_path) as repos, min(file_path) as repo from functions_v group by 1)
    select distinct c.file_path, c.callee, case when s.fn_id is not null then 'same' when g.repos = 1 then 'cross' when g.repos > 1 then 'ambiguous' else 'external' end as scope from calls_v c left join s on s.name = c.callee and s.file_path = c.file_path left join g on g.name = c.callee""",
)
def jn24(t):
    local = t.functions_v.select(F.col("name").alias("callee"), "file_path").distinct().withColumn("same", F.lit(True))
    owners = joins.unique_targets(t.functions_v.withColumnRenamed("name", "callee"), ["callee"], "file_path", "repo")
    rows = t.calls_v.select("file_path", "callee").distinct().join(local, ["file_path", "callee"], "left").join(owners, "callee", "left")
    scope = F.when(F.col("same"), "same").when(F.col("repo_n") == 1, "cross").when(F.col("repo_n") > 1, "ambiguous").otherwise("external")
    return rows.select("file_path", "callee", scope.alias("scope"))


@query(
    "jn34_endpoint_handlers",
    """with e as (select page_id, page_id * 5 as wanted, 'pkg.m' || (page_id % 20) || '.f' || (page_id * 3) as qualified_name, 'F' || (page_id % 60) as operation from endpoints_v),
    leaf as (select name, min(fn_id) as fn_id from functions_v group by 1)
    select page_id, case when a.fn_id is not null and page_id % 2 = 0 then 'id' when b.fn_id is not null then 'name' when leaf.fn_id is not null then 'operation' else 'virtual' end as how,
      case when a.fn_id is not null and page_id % 2 = 0 then a.fn_id when b.fn_id is not null then b.fn_id else leaf.fn_id end as fn_id
    from e left join functions_v a on a.fn_id = e.wanted left join functions_v b on b.qualified_name = e.qualified_name left join leaf on leaf.name = lower(operation)""",
)
def jn34(t):
    """By id where the endpoint has one, else by qualified name, else by the lower-cased operation, else a virtual node."""
    p = F.col("page_id")
    wanted = F.when(p % 2 == 0, p * 5)
    qualified = F.concat(F.lit("pkg.m"), (p % 20).cast("string"), F.lit(".f"), (p * 3).cast("string"))
    rows = t.endpoints_v.select("page_id", wanted.alias("wanted"), qualified.alias("qualified_name"), F.lower(F.concat(F.lit("F"), (p % 60).cast("string"))).alias("name"))
    f = t.functions_v
    leaf = f.groupBy("name").agg(F.min("fn_id").alias("c"))
    rows = rows.join(f.select(F.col("fn_id").alias("wanted"), F.col("fn_id").alias("a")), "wanted", "left")
    rows = rows.join(f.select("qualified_name", F.col("fn_id").alias("b")), "qualified_name", "left").join(leaf, "name", "left")
    how = F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "name").when(F.col("c").isNotNull(), "operation").otherwise("virtual")
    return rows.select("page_id", how.alias("how"), F.coalesce("a", "b", "c").alias("fn_id"))


@query(
    "gr10_fallback_paths",
    """with p as (select distinct f.file_path as a, g.file_path as b, overlay from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id)
    select a, b, min(case overlay when 'call' then 0 when 'semantic' then 1 else 2 end) as precision from p group by 1, 2""",
)
def gr10(t):
    """The most precise overlay that connects two files."""
    files = t.functions_v.select("fn_id", "file_path")
    rank = F.when(F.col("overlay") == "call", 0).when(F.col("overlay") == "semantic", 1).otherwise(2)
    pairs = t.edges_v.join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst")
    return pairs.groupBy("a", "b").agg(F.min(rank).alias("precision"))


@query(
    "gr21_interprocedural",
    """select src, dst, callsite_id, 'call' as kind from edges_v where overlay = 'call' union all select dst, src, callsite_id, 'return' from edges_v where overlay = 'call'
    union all select src, dst, callsite_id, 'cfg' from edges_v e where overlay = 'cfg' and not exists (select 1 from edges_v c where c.overlay = 'call' and c.src = e.src and c.dst = e.dst)""",
)
def gr21(t):
    """Calls, their returns under the same site, and control edges where no direct call takes their place."""
    calls = t.edges_v.filter("overlay = 'call'").select("src", "dst", "callsite_id")
    plain = t.edges_v.filter("overlay = 'cfg'").select("src", "dst", "callsite_id").join(calls.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    named = lambda df, kind: df.select("src", "dst", "callsite_id", F.lit(kind).alias("kind"))
    return named(calls, "call").union(named(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "callsite_id"), "return")).union(named(plain, "cfg"))


@query("gr23_framework_overlay", "with i as (select distinct file_path from functions_v where name = 'f3') select f.fn_id as src, g.fn_id as dst from functions_v f join functions_v g on f.file_path = g.file_path where f.name = 'f9' and g.name in ('f1', 'f29') and f.file_path not in (select file_path from i)")
def gr23(t):
    """Injected calls from a container to the beans of its module, where the module has no explicit wiring."""
    wired = t.functions_v.filter("name = 'f3'").select("file_path").distinct()
    containers = t.functions_v.filter("name = 'f9'").join(wired, "file_path", "left_anti").select("file_path", F.col("fn_id").alias("src"))
    beans = t.functions_v.filter(F.col("name").isin("f1", "f29")).select("file_path", F.col("fn_id").alias("dst"))
    return joins.dealt_pairs(containers, beans, "file_path").select("src", "dst")


@query(
    "gr24_attack_surface",
    """with e as (select split_part(path, '/', 2) as area, count(*) as endpoints, count(*) filter (not auth_required) as open from endpoints_v group by 1),
    c as (select split_part(raw_url, '/', 2) as area, count(*) as calls from client_calls_v group by 1) select area, endpoints, open, coalesce(calls, 0) as calls from e left join c using (area)""",
)
def gr24(t):
    """Endpoints by their first segment, those without authentication, and the client calls that aim there."""
    area = lambda c: F.split_part(c, F.lit("/"), F.lit(2)).alias("area")
    served = t.endpoints_v.groupBy(area("path")).agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(~F.col("auth_required")).alias("open"))
    called = t.client_calls_v.groupBy(area("raw_url")).agg(F.count(F.lit(1)).alias("calls"))
    return served.join(called, "area", "left").select("area", "endpoints", "open", F.coalesce("calls", F.lit(0)).alias("calls"))


@query(
    "gr12_entry_components_between",
    """with recursive u as (select distinct f.file_path as a, g.file_path as b from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id where overlay = 'call' and g.name = 'f7' and f.name = 'f1'),
    s as (select a, b from u union select b, a from u), r(a, b) as (select a, a from s union select r.a, s.b from r join s on s.a = r.b) select a as file_path, min(b) as root, count(*) as size from r group by 1""",
)
def gr12_components(t):
    """Connected files: the closure of an undirected reach, the least file for a name."""
    files = t.functions_v.select("fn_id", "file_path", "name")
    e = t.edges_v.filter("overlay = 'call'").join(files.filter("name = 'f1'").toDF("src", "a", "n1"), "src").join(files.filter("name = 'f7'").toDF("dst", "b", "n2"), "dst")
    links = graph.undirected(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    seeds = links.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    return graph.reach(links, seeds).groupBy(F.col("origin").alias("file_path")).agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("size"))


@query(
    "gr12_entry_components",
    """with recursive u as (select distinct f.file_path as a, g.file_path as b from edges_v e join functions_v f on e.src = f.fn_id join functions_v g on e.dst = g.fn_id where overlay = 'call'),
    s as (select a, b from u union select b, a from u), r(a, b) as (select a, a from s union select r.a, s.b from r join s on s.a = r.b) select a as file_path, min(b) as root, count(*) as size from r group by 1""",
)
def gr12_all_components(t):
    """Files that any calls connect, the least file for a name."""
    files = t.functions_v.select("fn_id", "file_path")
    e = t.edges_v.filter("overlay = 'call'").join(files.toDF("src", "a"), "src").join(files.toDF("dst", "b"), "dst")
    found = graph.components(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "root").select(F.col("node").alias("file_path"), "root", "size")


@query("tn04_call_targets", "select c.k_order, c.k_line, c.k_part, c.k_supp, c.k_price, case when e.dst is not null then 'edge' when n.n = 1 then 'name' else 'open' end as how from calls_v c left join (select src, min(dst) as dst from edges_v where overlay = 'call' group by 1) e on e.src = c.k_part left join (select name, count(*) as n from functions_v group by 1) n on n.name = c.callee")
def tn04(t):
    """An edge from the caller decides, else a unique name."""
    edge = t.edges_v.filter("overlay = 'call'").groupBy(F.col("src").alias("k_part")).agg(F.min("dst").alias("dst"))
    names = t.functions_v.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.calls_v.join(edge, "k_part", "left").join(names, "callee", "left")
    how = F.when(F.col("dst").isNotNull(), "edge").when(F.col("n") == 1, "name").otherwise("open")
    return rows.select("k_order", "k_line", "k_part", "k_supp", "k_price", how.alias("how"))


@query("tn05_call_strings", "select conv_id, turn, array_to_string(list(role) over (partition by conv_id order by turn rows between 3 preceding and current row), '>') as context from turns_v")
def tn05(t):
    """The last four calls."""
    last = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0))
    return t.turns_v.select("conv_id", "turn", F.array_join(last, ">").alias("context"))


@query("tn06_model_counts", "with m(name, kind, arg) as (values ('f1', 'source', -1), ('f7', 'sink', 0), ('f5', 'sanitizer', 0), ('f20', 'propagator', 1)) select kind, arg, count(*) as calls, count(distinct file_path) as files from calls_v join m on callee = name group by 1, 2")
def tn06(t):
    model = t.spark.createDataFrame([("f1", "source", -1), ("f7", "sink", 0), ("f5", "sanitizer", 0), ("f20", "propagator", 1)], "callee string, kind string, arg int")
    return t.calls_v.join(model, "callee").groupBy("kind", "arg").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("file_path").alias("files"))


@query(
    "tn10_sanitised_between",
    """with l as (select file_path, line, max(callee = 'f1') as src, max(callee = 'f5') as clean, max(callee = 'f7') as sink from (select file_path, line, callee, 1 from calls_v) group by 1, 2),
    m as (select *, max(case when src then line end) over w as source_line, max(case when clean then line end) over w as clean_line from l window w as (partition by file_path order by line rows between unbounded preceding and 1 preceding))
    select file_path, line, source_line, coalesce(clean_line > source_line, false) as sanitised from m where sink and source_line is not null""",
)
def tn10(t):
    lines = t.calls_v.groupBy("file_path", "line").agg(*(F.bool_or(F.col("callee") == f).alias(n) for n, f in (("src", "f1"), ("clean", "f5"), ("sink", "f7"))))
    w = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.max(F.when(F.col(c), F.col("line"))).over(w)
    marked = lines.select("file_path", "line", "sink", at("src").alias("source_line"), at("clean").alias("clean_line"))
    return marked.filter("sink and source_line is not null").select("file_path", "line", "source_line", F.coalesce(F.col("clean_line") > F.col("source_line"), F.lit(False)).alias("sanitised"))


@query("tn13_props", "select event_id, json_extract(props, '$.k')::bigint as k, json_extract(props, '$.k') is not null as present from events")
def tn13(t):
    facts = F.from_json("props", "k long")
    return t.events.select("event_id", facts["k"].alias("k"), facts["k"].isNotNull().alias("present"))


@query("rl13_disposition_rules", "with r(kind, rule_id, cwe) as (values ('blocking', 'SQLI', 89), ('advisory', 'PATH', 22)) select f.file_path, r.rule_id, cwe, count(*) as n from findings_v f join r on r.kind = f.disposition where evidence_state = 'reachable' group by 1, 2, 3")
def rl13(t):
    rules = t.spark.createDataFrame([("blocking", "SQLI", 89), ("advisory", "PATH", 22)], "disposition string, rule_id string, cwe int")
    rows = t.findings_v.filter("evidence_state = 'reachable'").select("file_path", "disposition")
    return rows.join(rules, "disposition").groupBy("file_path", "rule_id", "cwe").agg(F.count(F.lit(1)).alias("n"))


@query("rl14_lexical", r"""select page_id, regexp_matches(html, '<script') as script, regexp_matches(html, 'on(click|load)=') as handler, len(regexp_extract_all(html, '<[a-z]+'))::bigint as tags from pages""")
def rl14(t):
    h = F.col("html")
    return t.pages.select("page_id", h.rlike("<script").alias("script"), h.rlike("on(click|load)=").alias("handler"), F.regexp_count(h, F.lit("<[a-z]+")).cast("long").alias("tags"))


@query("rl16_mass_assignment", "select c.file_path, c.line, count(*) as n from calls_v c where callee = 'f8' and not exists (select 1 from calls_v g where g.callee = 'f5' and g.file_path = c.file_path and g.line = c.line - 7) group by 1, 2")
def rl16(t):
    guard = t.calls_v.filter("callee = 'f5'").select("file_path", (F.col("line") + 7).alias("line")).distinct()
    return t.calls_v.filter("callee = 'f8'").join(guard, ["file_path", "line"], "left_anti").groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("n"))


@query("flt09_executable_patterns", "select p_partkey, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then '.*' else p_type end as pattern, p_size % 4 not in (0, 1) as executable from part")
def flt09(t):
    """Patterns that match everything are not run."""
    pattern = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, ".*").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", pattern.alias("pattern")).withColumn("executable", ~F.col("pattern").isin("", ".*", ".+", "^.*$"))


@query("flt10_type_prefilter", "select distinct file_path from calls_v where callee in ('f1', 'f2') intersect select distinct file_path from calls_v where callee = 'f7'")
def flt10(t):
    """Files that hold both ends of a flow."""
    sources = t.calls_v.filter(F.col("callee").isin("f1", "f2")).select("file_path").distinct()
    return sources.join(t.calls_v.filter("callee = 'f7'").select("file_path"), "file_path", "left_semi")


@query("flt12_prose_lines", "select doc_id, line from source_lines_v where contains(code, ' of ') and not regexp_matches(code, '^[A-Z][a-z]+ [a-z ]+[.]$')")
def flt12(t):
    return t.source_lines_v.filter(F.contains("code", F.lit(" of ")) & ~F.col("code").rlike("^[A-Z][a-z]+ [a-z ]+[.]$")).select("doc_id", "line")


@query("fn10_dotted", "select fn_id, string_split(qualified_name, '.')[1] as package, string_split(qualified_name, '.')[2] as module, string_split(qualified_name, '.')[3] as symbol from functions_v")
def fn10(t):
    part = lambda n: F.split_part("qualified_name", F.lit("."), F.lit(n))
    return t.functions_v.select("fn_id", part(1).alias("package"), part(2).alias("module"), part(3).alias("symbol"))


@query("fn11_descriptors", "with d as (select p_partkey, '(' || repeat('I', p_size % 4) || 'Ljava/lang/String;' || ')V' as d from part) select p_partkey, len(regexp_extract_all(regexp_extract(d, '^[(](.*)[)]', 1), '\\[*(?:L[^;]+;|[BCDFIJSZ])')) as arity, regexp_extract(d, '[)](.*)$', 1) as result from d")
def fn11(t):
    d = F.concat(F.lit("("), F.repeat(F.lit("I"), F.col("p_size") % 4), F.lit("Ljava/lang/String;)V"))
    inner = F.regexp_extract(d, "^[(](.*)[)]", 1)
    return t.part.select("p_partkey", F.regexp_count(inner, F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZ])")).cast("long").alias("arity"), F.regexp_extract(d, "[)](.*)$", 1).alias("result"))


@query("fn22_span_millis", "select event_id, round(value * 1000000 / 1e6, 6)::double as ms from events where value >= 0")
def fn22(t):
    return t.events.filter("value >= 0").select("event_id", F.round(F.col("value") * 1_000_000 / F.lit(1e6), 6).alias("ms"))


@query("fn23_optional_casts", "select event_id, try_cast(event_type as bigint) as n, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn23(t):
    return t.events.select("event_id", F.col("event_type").try_cast("long").alias("n"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("fn26_flat_json", "select event_id, json_valid(props) and not contains(props, 'NaN') and len(regexp_extract_all(props, '\"k\"')) = 1 as strict from events")
def fn26(t):
    """Parses, holds no NaN, and names its key once."""
    ok = F.from_json("props", "map<string,string>").isNotNull() & ~F.contains("props", F.lit("NaN")) & (F.regexp_count("props", F.lit('"k"')) == 1)
    return t.events.select("event_id", ok.alias("strict"))


@query("lc14_bound_findings", "select f.scan_id, f.k_line, f.k_part, f.k_supp, f.k_price, g.fn_id is not null and f.line_end <= g.line_end as bound from findings_v f left join functions_v g on g.fn_id = f.k_part")
def lc14(t):
    """A finding is bound if the source that it names is retained and long enough."""
    kept = t.functions_v.select(F.col("fn_id").alias("k_part"), F.col("line_end").alias("last"))
    return t.findings_v.join(kept, "k_part", "left").select("scan_id", "k_line", "k_part", "k_supp", "k_price", (F.col("last").isNotNull() & (F.col("line_end") <= F.col("last"))).alias("bound"))


@query("src27_links", "select page_id, ord, raw_url from (select *, row_number() over (partition by page_id, raw_url order by ord) as n from client_calls_v) where n = 1")
def src27(t):
    """Calls extracted from pages by a pattern, each (page, url) once."""
    return first_of(t.client_calls_v, ["page_id", "raw_url"], ["ord"]).select("page_id", "ord", "raw_url")


@query("src28_methods", "select repository_id, path, max(method) as method from routes_v group by 1, 2")
def src28(t):
    return t.routes_v.groupBy("repository_id", "path").agg(F.max("method").alias("method"))


@query("src36_run_health", "select project_id, case when bool_or(status = 'running') then 'failed' when bool_or(status = 'partial') then 'partial' else 'completed' end as health, least(count(*) filter (status <> 'completed'), 100) as gaps from scans_v group by 1")
def src36(t):
    """Failed over partial over completed."""
    health = F.when(F.bool_or(F.col("status") == "running"), "failed").when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("completed")
    return t.scans_v.groupBy("project_id").agg(health.alias("health"), F.least(F.count_if(F.col("status") != "completed"), F.lit(100)).alias("gaps"))


@query("snk11_rule_sync", "with old as (select p_brand as rule_id, max(p_size) as version, bool_or(p_size > 40) as enabled from part where p_size < 45 group by 1), new as (select p_brand as rule_id, max(p_size) as version from part where p_size > 10 group by 1) select coalesce(o.rule_id, n.rule_id) as rule_id, coalesce(n.version, o.version) as version, coalesce(o.enabled, true) as enabled from old o full join new n on o.rule_id = n.rule_id")
def snk11(t):
    """An update takes the new version and keeps whether the rule is enabled."""
    old = t.part.filter("p_size < 45").groupBy(F.col("p_brand").alias("rule_id")).agg(F.max("p_size").alias("v"), F.bool_or(F.col("p_size") > 40).alias("e"))
    new = t.part.filter("p_size > 10").groupBy(F.col("p_brand").alias("rule_id")).agg(F.max("p_size").alias("w"))
    return old.join(new, "rule_id", "full").select("rule_id", F.coalesce("w", "v").alias("version"), F.coalesce("e", F.lit(True)).alias("enabled"))


@query("ag19_entropy", "with c as (select p_partkey, unnest(string_split(p_type, '')) as c, length(p_type) as n from part), k as (select p_partkey, n, count(*) as k from c group by p_partkey, c, n) select p_partkey, round(-sum(k / n::double * log2(k / n::double)), 6) as bits from k group by 1")
def ag19(t):
    return t.part.select("p_partkey", F.round(fn.entropy(F.col("p_type")), 6).alias("bits"))
