"""Readers of evidence and reports whose records may be malformed: typed with variants, so that a wrong kind is told from a missing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fn

_RECORD = "struct<id:string,method:string,path:string,url:string,status_code:int,status:int,duration_ms:double,passed:boolean>"
_BUNDLE = f"struct<contract_version:int,producer:string,producer_version:string,cases:array<{_RECORD}>,requests:array<{_RECORD}>>"
_REPORT = """struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,
  results:array<struct<ruleId:string,message:struct<text:string>,
    locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long,endLine:long>>>>>>>>>"""
_DEPENDENCY = "struct<groupId:string,artifactId:string,version:string,scope:string>"
_POM = f"""struct<groupId:string,artifactId:string,version:string,parent:struct<groupId:string,version:string>,properties:map<string,string>,
  dependencies:struct<dependency:array<{_DEPENDENCY}>>,dependencyManagement:struct<dependencies:struct<dependency:array<{_DEPENDENCY}>>>>"""
# What a record of a kind may hold, and how much of an artefact is shown.
TEXTS = {
    "frontend": ["id", "path", "method", "filePath", "client", "repositoryId", "matchKind"],
    "gateway": ["id", "uri", "file_path", "repository_id", "matchKind"],
    "runtime": ["id", "kind", "method", "path", "traceId", "spanId", "repositoryId", "matchKind"],
}
NUMBERS = {"frontend": ["line", "confidence", "linkConfidence"], "gateway": ["line", "confidence", "linkConfidence"], "runtime": ["statusCode", "durationMs", "linkConfidence"]}
SHOWN, LONGEST = 200, 4096


def runtime_evidence(files: DataFrame, key: str = "cases") -> DataFrame:
    """Recorded requests of files (``path``, ``body``) of contract version 1: ``evidence_id``, ``method``, ``route``, ``status_code``, ``duration_ms``, ``passed``, ``tool``.

    Other versions and files that are not JSON give no rows, nor do records without a path.  ``key`` is ``cases`` or ``requests``."""
    bundle = files.select(F.sha2("body", 256).alias("digest"), F.from_json("body", _BUNDLE).alias("j")).filter("j.contract_version = 1")
    rows = bundle.select("digest", F.concat_ws(" ", "j.producer", "j.producer_version").alias("tool"), F.posexplode(f"j.{key}").alias("pos", "r"))
    full = lambda name: F.nullif(F.col(f"r.{name}"), F.lit(""))
    placed = rows.withColumn("method", F.upper(F.coalesce(full("method"), F.lit("GET")))).withColumn("route", fn.client_path(F.coalesce(full("path"), full("url"))))
    own = fn.evidence_id("runtime:", F.col("digest"), F.coalesce(full("id"), F.col("pos").cast("string")), F.col("method"), F.col("route"))
    return placed.filter("route <> ''").select(
        own.alias("evidence_id"), "method", "route", F.coalesce("r.status_code", "r.status").alias("status_code"), "r.duration_ms", "r.passed", "tool"
    )


def _kind(value: Column, name: str) -> Column:
    """The kind of a member as a type's name; null or ``VOID`` where there is none."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))


def _given(value: Column, name: str) -> Column:
    kind = _kind(value, name)
    return kind.isNotNull() & (kind != "VOID")


def _text(value: Column, name: str) -> Column:
    found = F.when(_kind(value, name) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))
    return F.when(F.length(found) <= LONGEST, F.regexp_replace(found, "(?s)[?#].*", "") if name in ("path", "uri") else found)


def _number(value: Column, name: str) -> Column:
    n = F.when(_kind(value, name).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, f"$.{name}", "double"))
    fits = n >= 0
    if "confidence" in name.lower():
        fits &= n <= 1
    if name == "line":
        fits &= (n > 0) & (n < 2**53) & (n == F.floor(n))
    if name == "statusCode":
        fits &= n.between(100, 599) & (n == F.floor(n))
    return F.when(fits, n)


def _records(value: Column) -> Column:
    return F.slice(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), 1, SHOWN)


def endpoint_evidence(rows: DataFrame, raw: str, kind: str) -> DataFrame:
    """The first ``SHOWN`` records (that bound is the feature) of the JSON array in ``raw``, a row each beside the row's own columns.

    ``pos``, ``item_id``, ``label``, ``item_method``, ``location``, ``confidence``, ``malformed`` (a field was left out, being of a wrong kind or out of range) and ``kept``
    (it has something to be known by).  A text that is not an array gives no rows."""
    at = rows.select("*", F.posexplode(_records(F.col(raw))).alias("pos", "_v"))
    v = F.col("_v")
    texts = {n: _text(v, n) for n in TEXTS[kind]}
    numbers = {n: _number(v, n) for n in NUMBERS[kind]}
    wrong = F.lit(False)
    for name, value in {**texts, **numbers}.items():
        wrong |= _given(v, name) & value.isNull()
    full = lambda *names: F.coalesce(*(F.nullif(texts[n], F.lit("")) for n in names if n in texts), F.lit(None).cast("string"))
    place, file, trace = full("path", "uri"), full("filePath", "file_path"), full("traceId")
    line = F.concat(F.lit(":"), numbers["line"].cast("long").cast("string")) if "line" in numbers else F.lit("")
    known = texts["id"].isNotNull() & (texts["id"] != "") | place.isNotNull() | file.isNotNull() | trace.isNotNull()
    return at.select(
        *rows.columns, "pos", texts["id"].alias("item_id"),
        F.coalesce(place, full("client", "kind"), F.lit("Recorded link")).alias("label"),
        F.coalesce(full("method"), F.lit("—")).alias("item_method"),
        F.coalesce(F.concat(file, F.coalesce(line, F.lit(""))), F.concat(F.lit("Trace "), trace), F.lit("Source location not included")).alias("location"),
        numbers["linkConfidence"].alias("confidence"), (wrong | ~known).alias("malformed"), known.alias("kept"),
    )


def evidence_steps(rows: DataFrame, raw: str) -> DataFrame:
    """Valid steps among the first ``SHOWN`` of the JSON array in ``raw``: the row's columns, ``pos``, ``step_file``, ``step_line``, ``step_message``."""
    at = rows.select("*", F.posexplode(_records(F.col(raw))).alias("pos", "_v"))
    v = F.col("_v")
    string = lambda n: F.when(_kind(v, n) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
    steps = at.select(*rows.columns, "pos", string("file").alias("step_file"), _number(v, "line").cast("long").alias("step_line"), string("message").alias("step_message"))
    return steps.dropna(subset=["step_file", "step_line", "step_message"])


def snippet_start(snippet: Column, line_start: Column, line_end: Column, stated: Column) -> Column:
    """The line that a snippet starts at: what its record states, else the finding's own line unless the snippet has more lines than the finding."""
    lines = F.regexp_count(F.regexp_replace(snippet, "\r\n", "\n"), F.lit("\n")) + 1
    return F.when(stated.isNotNull(), F.when(stated > 0, stated)).when((lines <= line_end - line_start + 1) & (line_start > 0), line_start)


def sarif_problem(files: DataFrame) -> DataFrame:
    """``path`` and ``problem``, the first reason why a report is refused; null for one that is accepted."""
    run = F.col("j.runs")[0]
    place = lambda r: r["locations"][0]["physicalLocation"]
    rule = lambda r: F.coalesce(r["ruleId"], F.lit(""))
    named = lambda r: F.length(rule(r)).between(1, 128) & (F.trim(rule(r)) == rule(r)) & ~rule(r).rlike(r"[\x00-\x1f]")
    told = lambda r: F.coalesce(F.length(r["message"]["text"]) <= 100_000, F.lit(False))
    start, end = (lambda r: place(r)["region"]["startLine"]), (lambda r: place(r)["region"]["endLine"])
    inside = lambda r: place(r)["region"].isNull() | F.coalesce((start(r) >= 1) & (end(r).isNull() | (end(r) >= start(r))), F.lit(False))
    uri = lambda r: place(r)["artifactLocation"]["uri"]
    shaped = (F.col("j.version") == "2.1.0") & (F.size("j.runs") == 1) & run["tool"]["driver"].isNotNull() & run["results"].isNotNull()
    problem = (
        F.when(~F.coalesce(shaped, F.lit(False)), "not one run of SARIF 2.1.0")
        .when(F.size(run["results"]) > 50_000, "too many results")
        .when(F.exists(run["results"], lambda r: ~named(r) | ~told(r)), "rule or message")
        .when(F.exists(run["results"], lambda r: ~inside(r)), "source range")
        .when(F.exists(run["results"], lambda r: uri(r).isNotNull() & fn.normal_path(uri(r)).isNull()), "source path")
        .when(F.coalesce(F.size(run["tool"]["driver"]["rules"]), F.lit(0)) > 10_000, "too many rules")
    )
    return files.select("path", F.from_json("body", _REPORT).alias("j")).select("path", problem.alias("problem"))


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of POM files (``path``, ``body``), tests left out: ``path``, ``group_id``, ``artifact_id``, ``version``, ``exact`` (all three are known and hold no range)."""
    pom = files.select("path", F.from_xml("body", _POM).alias("p")).filter("p is not null")
    group, version = F.coalesce("p.groupId", "p.parent.groupId"), F.coalesce("p.version", "p.parent.version")
    own = F.create_map(F.lit("project.groupId"), group, F.lit("project.artifactId"), F.col("p.artifactId"), F.lit("project.version"), version)
    given = F.map_filter(F.coalesce("p.properties", F.create_map().cast("map<string,string>")), lambda k, _: ~F.startswith(k, F.lit("project.")))
    rows = pom.select("path", "p", F.map_concat(given, own).alias("names"))

    def filled(value: Column) -> Column:
        holes = F.array_distinct(F.regexp_extract_all(value, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))
        put = lambda text, name: F.replace(text, F.concat(F.lit("${"), name, F.lit("}")), F.coalesce(F.try_element_at(F.col("names"), name), F.concat(F.lit("${"), name, F.lit("}"))))
        return F.when(value.isNotNull(), F.aggregate(holes, F.trim(value), put))

    managed = F.col("p.dependencyManagement.dependencies.dependency")
    each = rows.select("path", "names", managed.alias("managed"), F.explode("p.dependencies.dependency").alias("d"))
    facts = each.select("path", "names", "managed", filled(F.col("d.groupId")).alias("group_id"), filled(F.col("d.artifactId")).alias("artifact_id"), filled(F.col("d.version")).alias("own"), filled(F.col("d.scope")).alias("scope"))
    same = F.filter("managed", lambda m: (filled(m["groupId"]) == F.col("group_id")) & (filled(m["artifactId"]) == F.col("artifact_id")))
    kept = facts.filter("scope is null or scope <> 'test'").withColumn("version", F.coalesce("own", filled(F.try_element_at(same, F.lit(1))["version"])))
    exact = F.concat_ws(" ", "group_id", "artifact_id", "version").rlike(r"^[^ ]+ [^ ]+ [^ ]+$") & ~F.coalesce(F.col("version"), F.lit("")).rlike(r"[\[\](),+*$]")
    return kept.select("path", "group_id", "artifact_id", "version", exact.alias("exact"))
