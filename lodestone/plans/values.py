"""Queries of scalar functions over many forms of their input, of identities and of progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import lifecycle as op
from lodestone.operators.findings import first_of
from lodestone.plans.registry import query



def _p():
    return F.col("p_partkey")


def _s():
    return F.col("p_size")


def _form(n: int, *forms):
    """One of several columns by the part's number."""
    out = F.when(_p() % n == 0, forms[0])
    for k, f in enumerate(forms[1:-1], 1):
        out = out.when(_p() % n == k, f)
    return out.otherwise(forms[-1])


def _text(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


@query("fn05_path_params", "select p_partkey, case p_partkey % 4 when 0 then 'id,b' when 1 then 'k' || p_size when 2 then 'a,c,d' else '' end as params from part")
def fn05(t):
    path = _form(4, F.lit("/a/{id}/<int:b>"), _text("/:k", _s(), "/x"), F.lit("/<a>/b/:c/{d}"), F.lit("/plain"))
    return t.part.select("p_partkey", F.array_join(fn.every_param(path), ",").alias("params"))


@query(
    "fn06_joined_paths",
    """select p_partkey, case p_partkey % 5 when 0 then '/u/:id/' || p_size when 1 then '/:slug*' when 2 then '/:rest*/x' else '/' end as next,
      case p_partkey % 5 when 0 then '/v1/' || p_size when 1 then '/a/b' when 2 then '/x' when 3 then '' else '/only' end as swift from part""",
)
def fn06(t):
    """Next.js route files and Swift registrations."""
    next_ = _form(5, _text("web/app/(shop)/u/[id]/", _s(), "/route.ts"), F.lit("app/[[...slug]]/route.js"), F.lit("src/app/[...rest]/x/route.tsx"), F.lit("app/route.ts"), F.lit("lib/route.go"))
    swift = _form(5, _text('"v1", "', _s(), '", use: show'), F.lit("'a', '/b/'"), F.lit('"/x", use: "no"'), F.lit("use: h"), F.lit('"only"'))
    return t.part.select("p_partkey", fn.next_route(next_).alias("next"), fn.joined_components(swift).alias("swift"))


@query(
    "fn10_symbols",
    """select p_partkey, case p_partkey % 4 when 0 then 'scip-java' when 1 then 'local' end as scheme, case p_partkey % 4 when 0 then 'a lib' || p_size end as name, case p_partkey % 4 when 0 then '1.' || p_size end as version,
      case p_partkey % 4 when 0 then 'a/B#c().' end as descriptors, case p_partkey % 4 when 1 then p_size::varchar end as local_id from part""",
)
def fn10(t):
    """Symbols with doubled blanks, local ones, ones that lack a field, and texts that are none."""
    symbol = _form(4, _text("scip-java maven a  lib", _s(), " 1.", _s(), " a/B#c()."), _text("local ", _s()), F.lit("scip-java  lib 1 a/B#"), F.lit("local "))
    part = fn.symbol_parts(symbol)
    return t.part.select("p_partkey", part["scheme"].alias("scheme"), part["name"].alias("name"), part["version"].alias("version"), part["descriptors"].alias("descriptors"), part["local"].alias("local_id"))


@query(
    "fn14_severity",
    """select p_partkey, case p_partkey % 6 when 0 then (case when p_size > 45 then 'critical' when p_size >= 35 then 'high' when p_size >= 20 then 'medium' else 'low' end) when 1 then 'high' when 2 then 'medium' when 3 then 'critical' else 'low' end as severity,
      case p_partkey % 6 when 0 then 0.98 when 1 then 0.9 when 2 then 0.75 when 3 then 0.55 else 0.8 end::double as precision from part""",
)
def fn14(t):
    """Scores before levels, levels by other tools' names, nonsense and nulls; and precisions."""
    score = _form(6, (_s() / 5.0).cast("string"), F.lit("0"), F.lit(None).cast("string"), F.lit("x"), F.lit("-1"), F.lit(None).cast("string"))
    level = _form(6, F.lit("note"), F.lit("ERROR"), F.lit("Warning"), F.lit("critical"), F.lit("note"), F.lit(None).cast("string"))
    precision = _form(6, F.lit("very-high"), F.lit("HIGH"), F.lit("medium"), F.lit("low"), F.lit("odd"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", fn.level_of(score, level).alias("severity"), fn.precision_of(precision).alias("precision"))


@query("fn25_canonical_json", r"""select p_partkey, sha256('{"a":"\u00e9\ud83d\ude00 ' || p_name || '","b":[' || p_size || ',null],"c":"\"\\\n"}') as digest from part""")
def fn25(t):
    """Sorted keys, no blanks, ASCII only: quotes, line feeds, accents and a surrogate pair."""
    body = F.to_json(F.struct(_text("\u00e9\U0001f600 ", F.col("p_name")).alias("a"), F.array(_s(), F.lit(None)).alias("b"), F.lit('"\\\n').alias("c")))
    return t.part.select("p_partkey", F.sha2(fn.ascii_json(body), 256).alias("digest"))


@query("fn26_strict_json", "select p_partkey, p_partkey % 7 = 0 as strict from part")
def fn26(t):
    """One form in seven is fine; the others repeat a key deep down, hold NaN, overflow, are an array, are broken, or null."""
    body = _form(7, _text('{"a": {"k": ', _s(), ', "l": [1.5e3]}}'), _text('{"a": [{"k": 1, "k": ', _s(), "}]}"), F.lit('{"a": NaN}'), F.lit('{"a": 1e999}'), F.lit("[1]"), F.lit('{"a": }'), F.lit(None).cast("string"))
    return t.part.select("p_partkey", fn.strict_json(body).alias("strict"))


@query("fn28_dates", "select p_partkey, case p_partkey % 6 when 0 then timestamp '2024-02-29 00:00:00' when 1 then timestamp '2024-01-05 07:08:09.120' end as at from part")
def fn28(t):
    """Days and times that exist; days that don't, other precisions, zones and blanks."""
    text = _form(6, F.lit("2024-02-29"), F.lit("2024-01-05T07:08:09.120Z"), F.lit("2023-02-29"), F.lit("2024-01-05T07:08:09Z"), F.lit("2024-01-05T07:08:09.120+01:00"), F.lit(""))
    return t.part.select("p_partkey", fn.strict_date(text).alias("at"))


@query("flt07_test_files", "select p_partkey, p_partkey % 7 < 4 as is_test from part")
def flt07(t):
    path = _form(7, _text("src/tests/a", _s(), ".py"), F.lit("a/b/test_x.py"), F.lit("src\\test\\A.java"), F.lit("x/y.spec.ts"), F.lit("src/contest/a.py"), F.lit("latest/b.ts"), F.lit("src/attest_a.py"))
    return t.part.select("p_partkey", fn.is_test_file(path).alias("is_test"))


@query(
    "lc03_producer_precedence",
    """select p_partkey, case p_partkey % 4 when 0 then sha256('["producer/v2","R' || p_size || '","","a.py","primaryLocationLineHash","h' || p_size || '"]') when 1 then sha256('["producer/v2","R' || p_size || '","","a.py","primaryLocationStartColumnFingerprint","c"]') else 'own' || p_partkey end as fingerprint from part""",
)
def lc03(t):
    """The first preferred one, the second where the first is blank or missing, else the engine's own."""
    entry = lambda name, value: F.create_map(F.lit(name), value)
    given = _form(4, F.map_concat(entry("primaryLocationLineHash", _text(" h", _s(), " ")), entry("other", F.lit("o"))), F.map_concat(entry("primaryLocationLineHash", F.lit("  ")), entry("primaryLocationStartColumnFingerprint", F.lit("c"))), entry("other", F.lit("o")), F.lit(None).cast("map<string,string>"))
    return t.part.select("p_partkey", op.producer_fingerprint(given, _text("own", _p()), _text(" R", _s()), F.lit(None).cast("string"), F.lit("a.py")).alias("fingerprint"))


TRI = "case {x} % 3 when 0 then true when 1 then false end"


@query(
    "lc11_applicability",
    f"""with e as (select p_partkey, {TRI.format(x="p_partkey")} as present, {TRI.format(x="p_size")} as affected, {TRI.format(x="(p_partkey // 3)")} as reachable, p_partkey % 11 = 0 as verified from part)
    select p_partkey, case when present = false or affected = false then 'not_affected' when verified then 'exploitable_in_fixture' when reachable and affected then 'reachable' when present and affected then 'version_exposed' else 'needs_evidence' end as verdict from e""",
)
def lc11(t):
    tri = lambda x: F.when(x % 3 == 0, True).when(x % 3 == 1, False)
    return t.part.select("p_partkey", op.applicability(tri(_p()), tri(_s()), tri(F.floor(_p() / 3)), _p() % 11 == 0).alias("verdict"))


@query(
    "lc06_reidentified",
    """with k as (select p_partkey as id, case p_partkey % 4 when 0 then 'fixed' when 1 then 'false_positive' when 2 then 'accepted' else 'open' end as status, p_size as occurrences, p_partkey % 3 = 0 as absent, p_partkey % 2 as revision, p_partkey % 5 = 0 as gone from part),
    s as (select distinct l_partkey * 2 as id from lineitem where l_linenumber < 3), j as (select coalesce(k.id, s.id) as id, k.*exclude(id), s.id is not null as seen from k full join s on k.id = s.id),
    r as (select *, seen and status is not null and gone as expired, seen and absent and status in ('fixed', 'false_positive') as again from j)
    select id, case when coalesce(expired or again, false) then 'open' else coalesce(status, 'open') end as status, coalesce(occurrences, 0) + seen::int as occurrences, case when seen then false else absent end as absent,
      coalesce(revision, 0) + coalesce(expired or again, false)::int as revision, case when expired then 'expired' when again then 'reappeared' end as reason from r""",
)
def lc06(t):
    """Identities through a scan: counts, absence, decisions that expire, findings that come back."""
    status = _form(4, F.lit("fixed"), F.lit("false_positive"), F.lit("accepted"), F.lit("open"))
    expires = F.when(_p() % 5 == 0, F.lit("2024-01-01").cast("timestamp")).when(_p() % 5 == 1, F.lit("2025-01-01").cast("timestamp"))
    known = t.part.select(_p().alias("id"), status.alias("status"), _s().alias("occurrences"), (_p() % 3 == 0).alias("absent"), (_p() % 2).alias("revision"), expires.alias("expires_at"))
    seen = t.lineitem.filter("l_linenumber < 3").select((F.col("l_partkey") * 2).alias("id"))
    return op.reidentified(known, seen, F.lit("2024-06-01").cast("timestamp"))


@query(
    "wn05_endpoint_dedup",
    """with e as (select page_id, repository_id, method, '/p' || (page_id % 9) as path, 'f' || (page_id % 4) as file_path, auth_required::int * 2 + page_id % 3 + (page_id % 2 = 0)::int as rich from endpoints_v),
    a as (select *, row_number() over (partition by path, method, file_path order by page_id) as n from e), b as (select *, row_number() over (partition by repository_id, path, method order by rich desc, page_id) as m from a where n = 1)
    select repository_id, path, method, page_id, rich from b where m = 1""",
)
def wn05(t):
    """The first of a path, method and file; of these the richest of a repository, path and method: two points for authentication, one for each parameter and for a framework."""
    p = F.col("page_id")
    rich = F.col("auth_required").cast("int") * 2 + p % 3 + (p % 2 == 0).cast("int")
    rows = t.endpoints_v.select("page_id", "repository_id", "method", _text("/p", p % 9).alias("path"), _text("f", p % 4).alias("file_path"), rich.cast("long").alias("rich"))
    once = first_of(rows, ["path", "method", "file_path"], ["page_id"])
    return first_of(once, ["repository_id", "path", "method"], [F.desc("rich"), "page_id"]).select("repository_id", "path", "method", "page_id", "rich")


#: The share of a scan that each of its phases takes.
WEIGHTS = [0.05, 0.25, 0.15, 0.2, 0.1, 0.2, 0.05]


@query(
    "wn13_progress",
    f"""with w(phase, weight) as (values {", ".join(f"({k}, {w})" for k, w in enumerate(WEIGHTS, 1))}), c as (select phase, weight, coalesce(sum(weight) over (order by phase rows between unbounded preceding and 1 preceding), 0) as earlier from w),
    e as (select event_id, event_id % 7 + 1 as phase, (event_id % 11) / 10.0 as part, value as elapsed from events)
    select event_id, round((earlier + weight * part)::double, 9) as overall, case when earlier + weight * part > 0.01 then round((elapsed / (earlier + weight * part)::double) * (1 - (earlier + weight * part)::double), 6) end as eta from e join c using (phase)""",
)
def wn13(t):
    """The weights of the phases before, and of the present one what is done of it; the time left at that rate."""
    weights = t.spark.createDataFrame(list(enumerate(WEIGHTS, 1)), "phase long, weight double")
    before = F.coalesce(F.sum("weight").over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = t.events.withColumns({"phase": F.col("event_id") % 7 + 1, "part": (F.col("event_id") % 11) / 10}).join(F.broadcast(weights.withColumn("earlier", before)), "phase")
    overall = F.col("earlier") + F.col("weight") * F.col("part")
    return rows.select("event_id", F.round(overall, 9).alias("overall"), F.when(overall > 0.01, F.round(F.col("value") / overall * (1 - overall), 6)).alias("eta"))
