"""Queries of evidence readers, declared endpoints, source snapshots and stores."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators.storage import Store, shared_dir
from lodestone.plans.registry import query
from lodestone.sources import artifacts, clients, endpoints, evidence, files, manifests, sinks


@query("fn09_annotations", "select p_partkey, '@Name' || (p_partkey % 7) as name, array_to_string(list_sort([p_brand, p_type]), '|') as strings from part")
def fn09(t):
    """The name of a qualified annotation and its distinct literals."""
    written = F.concat(F.lit("@api.v1.Name"), (F.col("p_partkey") % 7).cast("string"), F.lit('("'), "p_brand", F.lit("\", '"), "p_type", F.lit("', \""), "p_brand", F.lit('")'))
    rows = t.part.select("p_partkey", written.alias("a"))
    return rows.select("p_partkey", fn.annotation_name(F.col("a")).alias("name"), F.array_join(fn.annotation_strings(F.col("a")), "|").alias("strings"))


@query("fn12_decode_escapes", "select p_partkey, case when p_partkey % 5 > 0 then 'a' || chr(10) || chr((33 + p_size % 90)::int) || chr((19968 + p_size)::int) || p_name end as decoded from part")
def fn12(t):
    """Escapes by letter, of two and of four digits; one text in five holds an octal one."""
    code = lambda n, width: F.lpad(F.hex(n), width, "0")
    text = F.concat(F.lit("a\\n\\x"), code(33 + F.col("p_size") % 90, 2), F.lit("\\u"), code(19968 + F.col("p_size"), 4), "p_name", F.when(F.col("p_partkey") % 5 == 0, "\\07").otherwise(""))
    return t.part.select("p_partkey", fn.decode_escapes(text).alias("decoded"))


@query(
    "src21_runtime_evidence",
    "select '/e/' || event_id as route, upper(event_type) as method, (200 + event_id % 5)::int as status_code, round(value, 6) as duration_ms from events where event_id % 10 <> 0",
)
def src21(t):
    """Recorded requests come back from their files; one file in ten has another contract version."""
    case = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("method"), F.concat(F.lit("https://h/e/"), "event_id", F.lit("?q=1")).alias("url"),
                    (200 + F.col("event_id") % 5).alias("status"), F.col("value").alias("duration_ms"))
    version = F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)
    body = F.to_json(F.struct(version.alias("contract_version"), F.lit("probe").alias("producer"), F.array(case).alias("cases")))
    rows = evidence.runtime_evidence(t.events.select(F.lit("").alias("path"), body.alias("body")))
    return rows.select("route", "method", "status_code", F.round("duration_ms", 6).alias("duration_ms"))


@query(
    "src23_maven",
    "select p_partkey, 'org.' || p_size as group_id, 'lib' as artifact_id, '1.' || p_partkey as version, true as exact from part union all select p_partkey, 'm', 'n', case when p_size > 25 then '3' end, p_size > 25 from part",
)
def src23(t):
    """Properties are filled in, managed versions are found, tests are left out."""
    one = lambda g, a, rest="": f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId>{rest}</dependency>"
    managed = f"<dependencyManagement><dependencies>{one('m', 'n', '<version>3</version>')}</dependencies></dependencyManagement>"
    wanted = f"<dependencies>{one('${project.groupId}', 'lib', '<version>1.${k}</version>')}{one('m', 'n')}{one('x', 'y', '<scope>test</scope>')}</dependencies></project>"
    body = F.concat(F.lit("<project><groupId>org."), "p_size", F.lit("</groupId><artifactId>a</artifactId><version>1</version><properties><k>"), "p_partkey", F.lit("</k><unused>1</unused></properties>"),
                    F.when(F.col("p_size") > 25, managed).otherwise(""), F.lit(wanted))
    rows = evidence.maven(t.part.select(F.col("p_partkey").alias("path"), body.alias("body")))
    return rows.withColumnRenamed("path", "p_partkey")


@query("src26_changed_files", "select file_path as path, count(*) as functions from functions_v where file_path in (select file_path from calls_v where line < 20) group by 1")
def src26(t):
    """Functions of the files on a change list."""
    listed = t.calls_v.filter("line < 20").select(F.col("file_path").alias("path"))
    return files.changed(t.functions_v.withColumnRenamed("file_path", "path"), listed).groupBy("path").agg(F.count(F.lit(1)).alias("functions"))


@query(
    "src29_decorator_endpoints",
    """select p_partkey as line_start, 'Flask' as framework, '/p/<int:id>' as path, m as method, 'id' as params, true as auth_required from part, (values ('GET'), ('POST')) as v(m) where p_partkey % 4 = 0
    union all select p_partkey, 'FastAPI', '/q/{k}/' || p_size, 'PUT', 'k', false from part where p_partkey % 4 = 1
    union all select p_partkey, 'Spring', '/base' || p_size || '/r', 'PATCH', '', false from part where p_partkey % 4 = 2""",
)
def src29(t):
    """Decorators of three frameworks; one function in four imports none."""
    k = F.col("p_partkey") % 4
    marks = F.when(k == 0, F.array(F.lit("@app.route('/p/<int:id>', methods=['GET', 'post'])"), F.lit("@login_required"))).when(k == 2, F.array(F.lit('@RequestMapping(value = "/r", method = RequestMethod.PATCH)')))
    marks = marks.otherwise(F.array(F.concat(F.lit('@api.put("/q/{k}/'), "p_size", F.lit('")'))))
    modules = F.when(k == 0, F.array(F.lit("flask"))).when(k == 1, F.array(F.lit("fastapi.routing"))).otherwise(F.array(F.lit("os")))
    owner = F.when(k == 2, F.array(F.concat(F.lit('@RequestMapping("/base'), "p_size", F.lit('/")'))))
    functions = t.part.select(F.lit("f").alias("file_path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line_start"), marks.alias("decorators"), owner.alias("class_decorators"), modules.alias("modules"))
    return endpoints.from_decorators(functions).select("line_start", "framework", "path", "method", F.array_join("params", ",").alias("params"), "auth_required")


@query(
    "src30_source_endpoints",
    """select p_partkey as file_path, 'Express' as framework, 'GET' as method, '/a/' || p_size as path, (p_size + 1)::int as line from part where p_partkey % 3 = 0
    union all select p_partkey, 'Express', 'POST', '/b', (p_size + 2)::int from part where p_partkey % 3 = 0
    union all select p_partkey, 'Go router', 'ALL', '/g/' || p_size, (p_size + 1)::int from part where p_partkey % 3 = 1
    union all select p_partkey, 'Ktor', 'DELETE', '/k', (p_size + 1)::int from part where p_partkey % 3 = 2""",
)
def src30(t):
    """Registrations in sources of three languages, with their lines."""
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.concat(F.lit("app.get('/a/"), "p_size", F.lit("', h)\nrouter.post(\n'/b', h)"))).when(k == 1, F.concat(F.lit('r.Any("/g/'), "p_size", F.lit('", handle)'))).otherwise('delete("/k") { map.get("key") }')
    language = F.when(k == 0, "javascript").when(k == 1, "go").otherwise("kotlin")
    return endpoints.from_sources(t.part.select(F.col("p_partkey").alias("file_path"), language.alias("language"), F.concat(F.repeat(F.lit("\n"), F.col("p_size").cast("int")), body).alias("text")))


@query(
    "src35_small_snapshot",
    """with d as (select coalesce(source, '') as repository_id, doc_id, strlen(text) as size, sha256(text) as digest from documents where text is not null),
      s as (select *, sum(size) over (partition by repository_id order by doc_id rows unbounded preceding) as upto from d where size <= 4000)
    select repository_id, doc_id, size, digest from s where upto <= 200000""",
)
def src35(t):
    """Each source's files within small budgets of bytes, by folder and number."""
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    rows = t.documents.select(F.col("source").alias("repository_id"), F.substring(number, 1, 9).alias("folder"), number.alias("path"), F.encode("text", "UTF-8").alias("content"))
    kept, _ = files.snapshot(rows, 4000, 200_000)
    return kept.select("repository_id", F.col("path").cast("long").alias("doc_id"), "size", "digest")


@query(
    "src35_source_snapshot",
    """with d as (select coalesce(source, '') as repository_id, doc_id, strlen(text) as size, sha256(text) as digest from documents where text is not null),
      s as (select *, sum(size) over (partition by repository_id order by doc_id rows unbounded preceding) as upto from d where size <= 524288)
    select repository_id, doc_id, size, digest from s where upto <= 33554432""",
)
def src35_full(t):
    """The budgets of the reference: 512 KiB a file, 32 MiB a repository."""
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    rows = t.documents.select(F.col("source").alias("repository_id"), F.substring(number, 1, 9).alias("folder"), number.alias("path"), F.encode("text", "UTF-8").alias("content"))
    kept, _ = files.snapshot(rows, 512 << 10, 32 << 20)
    return kept.select("repository_id", F.col("path").cast("long").alias("doc_id"), "size", "digest")


@query(
    "src37_sarif_problems",
    """select scan_id, case when bool_or(k_part % 9 = 0) then 'rule or message' when bool_or(k_part % 11 = 0) then 'source range' when bool_or(k_part % 13 = 0) then 'source path' end as problem from findings_v group by 1""",
)
def src37(t):
    """Reports of scans, some of whose results have a loose rule id, a reversed range or a path outside."""
    k = F.col("k_part")
    loose = t.findings_v.withColumns({
        "rule_id": F.when(k % 9 == 0, F.concat("rule_id", F.lit(" "))).otherwise(F.col("rule_id")),
        "line_end": F.when(k % 11 == 0, F.col("line_start") - 1).otherwise(F.col("line_end")),
        "file_path": F.when(k % 13 == 0, "../x.py").otherwise(F.col("file_path")),
    })
    return evidence.sarif_problem(sinks.sarif_runs(loose, "probe", "scan_id").withColumnRenamed("scan_id", "path")).withColumnRenamed("path", "scan_id")


@query(
    "src38_endpoint_evidence",
    """with p as (select page_id, page_id % 50 - 5 as n from pages)
    select page_id, 0 as pos, '/x' as label, 'f.ts' || case when n > 0 then ':' || n else '' end as location, n <= 0 as malformed, true as kept from p
    union all select page_id, 1, 'axios', 'Source location not included', true, false from p union all select page_id, 2, 'Recorded link', 'Source location not included', true, false from p
    union all select page_id, 3, 'Recorded link', 'g.ts', true, true from p""",
)
def src38(t):
    """Stored records of the front end: a good one, two without identity, one with a field of another kind."""
    raw = F.concat(F.lit('[{"path":"/x?k=1","filePath":"f.ts","linkConfidence":0.5,"line":'), (F.col("page_id") % 50 - 5).cast("string"), F.lit('},{"client":"axios"},7,{"filePath":"g.ts","line":"4"}]'))
    return evidence.endpoint_evidence(t.pages.select("page_id", raw.alias("raw")), "raw", "frontend").select("page_id", "pos", "label", "location", "malformed", "kept")


@query(
    "src39_evidence_steps",
    """select fn_id, 0 as pos, (line_start - 10)::bigint as step_line, name as step_message, case when line_end > line_start then line_start end as start from functions_v where line_start > 10
    union all select fn_id, 1, line_end::bigint, 'sink', case when line_end > line_start then line_start end from functions_v""",
)
def src39(t):
    """Valid steps of stored flows and the line where a snippet of two lines starts."""
    step = lambda line, message: F.struct(F.col("file_path").alias("file"), line.alias("line"), message.alias("message"))
    raw = F.to_json(F.array(step(F.col("line_start") - 10, F.col("name")), step(F.col("line_end"), F.lit("sink"))))
    start = evidence.snippet_start(F.lit("a\r\nb"), F.col("line_start"), F.col("line_end"), F.lit(None).cast("int"))
    return evidence.evidence_steps(t.functions_v.select("fn_id", start.alias("start"), raw.alias("raw")), "raw").select("fn_id", "pos", "step_line", "step_message", "start")


@query("tn15_expression_reads", "select p_partkey, 'a' || (p_partkey % 9) || '|b.c' || p_size || '|d|e' as reads from part")
def tn15(t):
    """What an expression reads: fields of f-strings, receivers, arguments and indices, and no called name."""
    text = F.concat(F.lit('f"{a'), (F.col("p_partkey") % 9).cast("string"), F.lit('}lit".join(b.c'), "p_size", F.lit(", k=run(d[e]))"))
    return files.python_reads(t.part.select("p_partkey", text.alias("x")), "x").select("p_partkey", F.array_join("reads", "|").alias("reads"))


@query("snk08_upsert", "select cast(o_custkey % 8 as varchar) as project_id, o_custkey as file_key, max(o_orderkey) as version from orders group by 1, 2")
def snk08(t):
    """Two batches of hashes are stored; the later version of each file stays."""
    rows = t.orders.select((F.col("o_custkey") % 8).cast("string").alias("project_id"), F.col("o_custkey").alias("file_key"), F.col("o_orderkey").alias("version"))
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    for part in (0, 1):
        store.upsert("hashes", rows.filter(F.col("version") % 2 == part), ["file_key"], "version")
    return store.load("hashes").select("project_id", "file_key", "version")


@query("snk09_identities", "select sha256(rule_id || chr(31) || file_path || chr(31) || message) as identity, min(scan_id) as first_scan, max(scan_id) as last_scan, count(*) as occurrences from findings_v group by 1")
def snk09(t):
    """Reports come in as two batches: the second updates the identities of the first."""
    early = sinks.merged_identities(None, t.findings_v.filter("scan_id % 2 = 0"))
    return sinks.merged_identities(early, t.findings_v.filter("scan_id % 2 = 1"))


@query(
    "src14_contract",
    """select p_partkey as file, 'GET' as method, '/a/{x}' as route, 'header:trace|path:x|query:q' || p_size as params, 'required' as security, p_partkey % 3 = 0 as twice from part
    union all select p_partkey, 'POST', '/a/{x}', 'header:trace', 'none', false from part union all select p_partkey, 'GET', '/a/{y}', '', 'optional', true from part where p_partkey % 3 = 0""",
)
def src14(t):
    """References to parameters are followed; one contract in three has a route twice."""
    get = F.concat(F.lit('"get":{"parameters":[{"name":"x","in":"path"},{"name":"q'), "p_size", F.lit('","in":"query"}]},"post":{"security":[]},"parameters":[{"$ref":"#/components/parameters/A"},{"$ref":"http://h/x"}]'))
    other = F.when(F.col("p_partkey") % 3 == 0, ',"/a/{y}":{"get":{"security":[{},{"k":[]}]}}').otherwise("")
    shared = F.lit('},"components":{"parameters":{"A":{"$ref":"#/components/parameters/B"},"B":{"name":"trace","in":"header"}}}}')
    body = F.concat(F.lit('{"openapi":"3.0.1","security":[{"k":[]}],"paths":{"/a/{x}":{'), get, F.lit("}"), other, shared)
    return artifacts.contract(t.part.select(F.col("p_partkey").alias("path"), body.alias("body"))).withColumn("params", F.array_join("params", "|"))


@query(
    "src33_flow_models",
    """with c as (select *, case when file_path like '%.java' then 'java' when file_path like '%.py' then 'python' end as language from calls_v)
    select m as model_id, role, language, count(*) as calls from c join (values ('f1', 'a.source', 'source', 'java', null), ('f2', 'a.sink', 'sink', 'java', 0), ('f2', 'a.sink', 'sink', 'python', 0),
      ('f3', 'a.clean', 'sanitizer', 'python', null)) v(callee, m, role, lang, parity) on c.callee = v.callee and c.language = v.lang where parity is null or k_line % 2 = parity group by 1, 2, 3""",
)
def src33(t):
    """Calls beside the models of a pack, one of which asks for a receiver."""
    pack = manifests.models(t.spark, json.dumps({"models": [
        {"id": "a.source", "role": "source", "languages": ["java"], "callee": "f1", "source_type": "http_param"},
        {"id": "a.sink", "role": "sink", "languages": ["java", "python"], "callee": "f2", "sink_type": "os_command", "receiver_types": ["even"]},
        {"id": "a.clean", "role": "sanitizer", "languages": ["python"], "callee": "f3", "sanitizes": ["xss"]},
    ]}))
    calls = t.calls_v.select("callee", files.language(F.col("file_path")).alias("language"), F.when(F.col("k_line") % 2 == 0, "even").alias("receiver"))
    return manifests.modelled(calls, pack).groupBy("model_id", "role", "language").agg(F.count(F.lit(1)).alias("calls"))


@query(
    "src27_client_calls",
    """with f as (select p_partkey as file_path, p_size as n, p_partkey % 4 as k, p_partkey % 3 = 0 as js from part)
    select file_path, n + 1 as line, 'POST' as method, '/u/' || n as path, 'fetch' as client, false as dynamic from f where k = 0 and not js union all select file_path, n + 3, 'GET', '/v', 'fetch', false from f where k = 0 and not js
    union all select file_path, n + 1, 'DELETE', '/{dynamic}/w', 'axios', true from f where k = 1 and not js union all select file_path, n + 2, 'PATCH', '/z/' || n, 'axios', false from f where k = 2 and not js
    union all select file_path, n + 1, 'GET', '/', 'this.http', false from f where k = 3 and not js""",
)
def src27(t):
    """Four ways to call; urls with queries, holes and origins; other clients, repeats, and languages that are not read."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit("fetch('https://h.x//u/"), n, F.lit("?a=1', {\n body, method: \"post\" });\n fetch(`/v#t`); fetch('/v'); fetch('no')")))
        .when(k == 1, F.lit("axios.delete(`${base}/${id}/w`); Map.get('/m')").cast("string"))
        .when(k == 2, F.concat(F.lit("call();\naxios({ method: 'patch',\n url: \"/z/"), n, F.lit("\" })")))
        .otherwise("this.http.get( 'https://only.host' ); axios({ method: 'get' })")
    )
    body = F.when(k == 1, F.replace(body, F.lit("${base}/${id}"), F.lit("${id}/${id}"))).otherwise(body)
    text = F.concat(F.repeat(F.lit("\n"), F.col("p_size").cast("int")), body)
    files_ = t.part.select(F.col("p_partkey").alias("file_path"), F.when(F.col("p_partkey") % 3 == 0, "python").otherwise("javascript").alias("language"), text.alias("text"))
    return clients.client_calls(files_)


@query(
    "src28_gateway_routes",
    """select 'repo' || (p_size % 5) as repository_id, case when p_size % 3 = 0 then 'route-' || max(p_partkey) else 'r' || (p_size % 3) end as route_id, 'lb://s' || max(p_partkey) as uri, '/p' || p_size || '/**,/q' as patterns,
      case when max(p_partkey) % 2 = 0 then 'GET,PUT' else '' end as methods, 'StripPrefix:1;RewritePath:/a(?<x>.*)|/b/${x}, c' as filters from part group by p_size, case when p_size % 3 = 0 then p_partkey end""",
)
def src28(t):
    """Routes as configuration has them: the last of one id and its patterns counts, a nameless one has its own number."""
    p, n = F.col("p_partkey"), F.col("p_size").cast("string")
    predicates = F.array(F.concat(F.lit("Path=/p"), n, F.lit("/**, /q")), F.when(p % 2 == 0, "Method=get,PUT").otherwise("After=2024-01-01"))
    filters = F.array(F.lit("StripPrefix=1"), F.lit("RewritePath=/a(?<x>.*), '/b/${x}, c'"))
    rows = t.part.select(F.concat(F.lit("repo"), (F.col("p_size") % 5).cast("string")).alias("repository_id"), p.alias("nth"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("r"), (F.col("p_size") % 3).cast("string"))).alias("id"),
                         F.concat(F.lit("lb://s"), p.cast("string")).alias("uri"), predicates.alias("predicates"), filters.alias("filters"))
    shown = F.array_join(F.transform("filters", lambda f: F.concat(f["name"], F.lit(":"), F.array_join(f["args"], "|"))), ";")
    found = clients.configured_routes(rows)
    return found.select("repository_id", "route_id", "uri", F.array_join("patterns", ",").alias("patterns"), F.array_join("methods", ",").alias("methods"), shown.alias("filters"))
