"""Queries over endpoints, client calls and runtime observations, and the scalars they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import routes as op
from lodestone.operators.findings import first_of
from lodestone.plans.registry import query
from lodestone.sources import clients


@query(
    "jn12_call_matching",
    r"""with s as (select distinct method, path from routes_v union select distinct method, path from endpoints_v),
    c as (select call_id, method as call_method, regexp_replace(regexp_replace(regexp_replace(client_path, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g') as client_path from client_paths_v),
    x as (select call_id, path, 'exact' as how from c join s on client_path = path and (method = call_method or method = 'ALL'))
    select distinct * from (select * from x union all
    select call_id, path, 'template' from c join s on contains(path, '{') and (method = call_method or method = 'ALL')
      and regexp_full_match(client_path, regexp_replace(regexp_replace(path, '([.+*?^$()|])', '\\\1', 'g'), '[{][^}]*[}]', '[^/]+', 'g')) where (call_id, path) not in (select (call_id, path) from x))""",
)
def jn12(t):
    served = t.routes_v.select("method", "path").union(t.endpoints_v.select("method", "path"))
    return op.match_calls(t.client_paths_v, served)


@query(
    "jn13_two_filters",
    """with g as (select page_id, path, page_id % 3 as strip, case when page_id % 2 = 0 then '/api' else '' end as prefix from endpoints_v)
    select page_id, prefix || '/' || array_to_string(string_split(path, '/')[strip + 2:], '/') as path from g""",
)
def jn13(t):
    strip = (F.col("page_id") % 3).cast("int")
    return t.endpoints_v.select("page_id", op.through_gateway(F.col("path"), strip, F.when(F.col("page_id") % 2 == 0, "/api").otherwise("")).alias("path"))


@query(
    "jn14_pages_of_events",
    """select repository_id, e.method, count(distinct o.event_id) as observations, count(distinct e.path) as paths from observations_v o join endpoints_v e on o.event_id % 250 = e.page_id and (e.method = o.method or e.method = 'ALL') group by 1, 2""",
)
def jn14(t):
    seen = t.observations_v.select("event_id", F.col("method").alias("asked"), (F.col("event_id") % 250).alias("page_id"))
    pairs = seen.join(t.endpoints_v, "page_id").filter((F.col("method") == F.col("asked")) | (F.col("method") == "ALL"))
    return pairs.groupBy("repository_id", "method").agg(F.count_distinct("event_id").alias("observations"), F.count_distinct("path").alias("paths"))


@query("wn05_one_phase", "select repository_id, path, method, arg_min(page_id, (not auth_required, page_id)) as page_id from endpoints_v group by 1, 2, 3")
def wn05(t):
    return first_of(t.endpoints_v, ["repository_id", "path", "method"], [~F.col("auth_required"), "page_id"]).select("repository_id", "path", "method", "page_id")


@query("wn06_weighted_dedup", "select path, arg_max(page_id, (case method when 'ALL' then 1 when 'GET' then 2 else 3 end + case when auth_required then 5 else 0 end, page_id)) as page_id from endpoints_v group by 1")
def wn06(t):
    weight = F.when(F.col("method") == "ALL", 1).when(F.col("method") == "GET", 2).otherwise(3) + F.when(F.col("auth_required"), 5).otherwise(0)
    return t.endpoints_v.groupBy("path").agg(F.max(F.struct(weight.alias("w"), "page_id"))["page_id"].alias("page_id"))


@query("flt06_endpoint_quality", "select page_id, path from endpoints_v where starts_with(path, '/') and path <> '/' and not contains(path, '*') and not regexp_matches(path, '^/[{][^/]*[}]$') and not regexp_matches(path, '[.](css|js|png|html)$') and not starts_with(path, '/internal')")
def flt06(t):
    p = F.col("path")
    bad = F.contains(p, F.lit("*")) | p.rlike("^/[{][^/]*[}]$") | p.rlike("[.](css|js|png|html)$") | p.startswith("/internal")
    return t.endpoints_v.filter(p.startswith("/") & (p != "/") & ~bad).select("page_id", "path")


@query(
    "wn07_first_match",
    """with r(n, rx, label) as (values (1, '^/en/.*$', 'english'), (2, '^/de/[^/]*$', 'german page'), (3, '^/[^/]*/[^/]*[.]html$', 'page'), (4, '^/.*$', 'other'))
    select page_id, (select arg_min(label, n) from r where regexp_matches(path, rx)) as label from endpoints_v""",
)
def wn07(t):
    rules = [("/en/**", "english"), ("/de/*", "german page"), ("/*/*.html", "page"), ("/**", "other")]
    label = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        label = F.when(F.col("path").rlike(fn.ant_regex(pattern)), name).otherwise(label)
    return t.endpoints_v.select("page_id", label.alias("label"))


@query("fn02_client_path", "select page_id, ord, regexp_replace(regexp_replace(regexp_replace(raw_url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g') as path from client_calls_v")
def fn02(t):
    return t.client_calls_v.select("page_id", "ord", fn.client_path(F.col("raw_url")).alias("path"))


@query("fn03_canonical_template", "select path, regexp_replace(regexp_replace(regexp_replace(path, '<[^>]*>', '{}', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{}', 'g'), '[{][^}]*[}]', '{}', 'g') as template from routes_v")
def fn03(t):
    return t.routes_v.select("path", fn.canonical_template(F.col("path")).alias("template"))


@query("fn05_braces", "select path, array_to_string(regexp_extract_all(path, '[{]([^}]*)[}]', 1), ',') as params from routes_v")
def fn05(t):
    return t.routes_v.select("path", F.array_join(fn.path_params(F.col("path")), ",").alias("params"))


@query("lc04_normal_path", "select page_id, case when not contains(path, '..') then array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '' and p <> '.'), '/') end as path from endpoints_v")
def lc04(t):
    return t.endpoints_v.select("page_id", fn.normal_path(F.col("path")).alias("path"))


@query("st02_distinct_append", "select src, dst, overlay from edges_v where overlay = 'call' union select dst, src, overlay from edges_v where overlay = 'call'")
def st02(t):
    e = t.edges_v.filter("overlay = 'call'").select("src", "dst", "overlay")
    return e.union(e.select("dst", "src", "overlay")).distinct()


@query("st01_union_all", "select overlay, count(*) as n from (select src, overlay from edges_v union all select fn_id, 'function' from functions_v) group by 1")
def st01(t):
    every = t.edges_v.select("src", "overlay").union(t.functions_v.select("fn_id", F.lit("function")))
    return every.groupBy("overlay").agg(F.count(F.lit(1)).alias("n"))


@query("st03_coverage_lost", "select distinct file_path, rule_id from findings_v where evidence_state = 'candidate' except select file_path, rule_id from findings_v where confidence > 0.95")
def st03(t):
    old = t.findings_v.filter("evidence_state = 'candidate'").select("file_path", "rule_id")
    return old.subtract(t.findings_v.filter("confidence > 0.95").select("file_path", "rule_id"))


@query("st04_trusted", "select k_part from findings_v where disposition = 'blocking' intersect select fn_id from functions_v where line_end > 300")
def st04(t):
    return t.findings_v.filter("disposition = 'blocking'").select("k_part").intersect(t.functions_v.filter("line_end > 300").select("fn_id"))


@query("st05_module_sets", "select f.file_path, count(distinct c.file_path) filter (c.file_path = f.file_path) as same, count(distinct c.file_path) filter (c.file_path <> f.file_path) as cross_ from functions_v f join calls_v c on c.callee = f.name group by 1")
def st05(t):
    pairs = t.functions_v.select("name", "file_path").distinct().join(t.calls_v.select(F.col("callee").alias("name"), F.col("file_path").alias("caller")).distinct(), "name").select("file_path", "caller").distinct()
    return pairs.groupBy("file_path").agg(F.count_if(F.col("caller") == F.col("file_path")).alias("same"), F.count_if(F.col("caller") != F.col("file_path")).alias("cross_"))


@query("st06_ordered_distinct", "select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(turn) as first from turns_v group by 1, 2) group by 1")
def st06(t):
    first = t.turns_v.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "role")))["role"], ",").alias("roles"))


@query(
    "jn13_gateway",
    """with g as (select page_id, path, page_id % 5 as k, string_split(ltrim(path, '/'), '/') as parts from endpoints_v)
    select page_id, regexp_replace(case k when 0 then '/api/' || array_to_string(parts[3:], '/') when 1 then '/fixed/' || (page_id % 7) when 2 then regexp_replace(path, '^/([a-z]+)/(.*)$', '/v2/\\2/\\1')
      when 3 then regexp_replace(regexp_replace('/x/' || ltrim(path, '/'), '/+', '/', 'g'), '[0-9]+', '#', 'g') else path end, '/+', '/', 'g') as path from g""",
)
def jn13(t):
    """All four filters, chained, and filters that say nothing."""
    k, one = F.col("page_id") % 5, lambda name, *args: F.struct(F.lit(name).alias("name"), F.array(*(a if not isinstance(a, str) else F.lit(a) for a in args)).alias("args"))
    filters = (
        F.when(k == 0, F.array(one("StripPrefix", "2"), one("PrefixPath", "/api/")))
        .when(k == 1, F.array(one("SetPath", F.concat(F.lit("/fixed/"), (F.col("page_id") % 7).cast("string")))))
        .when(k == 2, F.array(one("RewritePath", "^/(?<lang>[a-z]+)/(?<rest>.*)$", "/v2/${rest}/${lang}")))
        .when(k == 3, F.array(one("PrefixPath", "x"), one("RewritePath", "[0-9]+", "#")))
        .otherwise(F.array(one("StripPrefix", "many"), one("AddHeader", "a")))
    )
    return t.endpoints_v.select("page_id", op.apply_filters(F.col("path"), filters).alias("path"))


@query(
    "jn14_observed_endpoints",
    r"""with e as (select repository_id, method, path from routes_v union select repository_id, method, path from endpoints_v),
    o as (select page_id * 1000 + ord as id, case when ord % 4 = 0 then 'POST' else 'GET' end as asked, regexp_replace(regexp_replace(regexp_replace(case when ord % 3 = 0 then '/gate' || raw_url else raw_url end, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g') as p from client_calls_v),
    b as (select * from o union all select id, asked, '/' || array_to_string(string_split(p, '/')[3:], '/') from o where starts_with(p, '/gate/') and asked = 'GET'),
    m as (select distinct id, repository_id, method, path from b join e on (method = asked or method = 'ALL') and (p = path or (contains(path, '{') and regexp_full_match(p, regexp_replace(regexp_replace(path, '([.+*?^$()|])', '\\\1', 'g'), '[{][^}]*[}]', '[^/]+', 'g')))))
    select e.repository_id, e.method, e.path, count(distinct id) as observations from e left join m on m.repository_id = e.repository_id and m.method = e.method and m.path = e.path group by 1, 2, 3""",
)
def jn14(t):
    """Requests by path: straight, by templates, and behind a gateway that takes off its own segment."""
    ends = t.routes_v.select("repository_id", "method", "path").union(t.endpoints_v.select("repository_id", "method", "path")).distinct()
    url = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("/gate"), "raw_url")).otherwise(F.col("raw_url"))
    seen = t.client_calls_v.select((F.col("page_id") * 1000 + F.col("ord")).alias("call_id"), F.when(F.col("ord") % 4 == 0, "POST").otherwise("GET").alias("method"), url.alias("client_path"))
    gate = t.spark.createDataFrame([("gate", ["GET"], ["/gate/**"], [("StripPrefix", ["1"])])], f"route_id string, methods array<string>, patterns array<string>, filters array<{clients.FILTER}>")
    return op.observed(seen, ends, gate)
