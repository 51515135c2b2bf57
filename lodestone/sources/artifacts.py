"""Readers of analysis artefacts: each turns files, one a row, into flat relations with built-in JSON functions.

A file that is not what its reader expects gives no rows; ``problems`` counts such files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fn

_SARIF = """struct<version:string,runs:array<struct<
  tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,properties:struct<tags:array<string>,`security-severity`:string>>>>>,
  results:array<struct<ruleId:string,level:string,message:struct<text:string>,
    locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>>"""
_HAR = """struct<log:struct<entries:array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string>,response:struct<status:int>>>>>"""
_OTEL = """struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<struct<
  traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,
  attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string>>>>>>>>>>"""
_OPERATION = "struct<operationId:string,parameters:array<struct<name:string,`in`:string>>,security:array<map<string,array<string>>>>"
_OPENAPI = "struct<basePath:string,servers:array<struct<url:string>>,paths:map<string,map<string,string>>,security:array<map<string,array<string>>>>"
_SEMGREP = """struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>>"""
# The HTTP methods that a path item may hold.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``body`` of every text file below ``path``."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def problems(files: DataFrame, kind: str) -> DataFrame:
    """Files whose body is not JSON of this kind."""
    schema, key = {"sarif": (_SARIF, "runs"), "har": (_HAR, "log"), "otel": (_OTEL, "resourceSpans"), "openapi": (_OPENAPI, "paths")}[kind]
    return files.filter(F.from_json("body", schema)[key].isNull()).select("path")


def sarif(files: DataFrame) -> DataFrame:
    """Results of SARIF 2.1.0 files with a location inside the repository: ``path``, ``tool``, ``rule_id``, ``level``, ``message``, ``file_path``, ``line_start``, ``line_end``, ``cwe``, ``severity``."""
    runs = files.select("path", F.from_json("body", _SARIF).alias("j")).filter("j.version = '2.1.0'").select("path", F.explode("j.runs").alias("run"))
    rules = F.map_from_entries(F.transform(F.coalesce("run.tool.driver.rules", F.array()), lambda r: F.struct(r["id"], r["properties"])))
    rows = runs.select("path", F.col("run.tool.driver.name").alias("tool"), rules.alias("rules"), F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    props = F.try_element_at("rules", F.col("r.ruleId"))
    level = F.coalesce("r.level", F.lit("warning"))
    score = props["security-severity"].cast("double")
    return rows.select(
        "path",
        "tool",
        F.col("r.ruleId").alias("rule_id"),
        level.alias("level"),
        F.col("r.message.text").alias("message"),
        fn.normal_path(place["artifactLocation"]["uri"]).alias("file_path"),
        place["region"]["startLine"].alias("line_start"),
        F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("line_end"),
        F.nullif(fn.cwe(F.array_join(props["tags"], ",")), F.lit("")).cast("int").alias("cwe"),
        F.when(score.isNotNull(), fn.severity_of(score)).otherwise(F.when(level == "error", "high").when(level == "warning", "medium").otherwise("low")).alias("severity"),
    ).filter("file_path is not null and line_start >= 1")


def semgrep(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(F.from_json("body", _SEMGREP)["results"]).alias("r"))
    return rows.select(
        "path", F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file_path"), F.col("r.start.line").alias("line_start"),
        F.col("r.end.line").alias("line_end"), F.col("r.extra.message").alias("message"), F.lower("r.extra.severity").alias("severity"),
    )


def har(files: DataFrame) -> DataFrame:
    """Requests without headers, cookies and bodies: ``method``, ``path`` (no query), ``status_code``, ``duration_ms``."""
    entries = files.select(F.col("path").alias("file"), F.explode(F.from_json("body", _HAR)["log"]["entries"]).alias("e"))
    return entries.select(
        "file", F.upper("e.request.method").alias("method"), fn.client_path(F.col("e.request.url")).alias("path"),
        F.col("e.response.status").alias("status_code"), F.col("e.time").alias("duration_ms"),
    )


def otel(files: DataFrame) -> DataFrame:
    """Spans, with their attributes as a map; a duration is null where the end lies before the start."""
    spans = (
        files.select(F.explode(F.from_json("body", _OTEL)["resourceSpans"]).alias("r"))
        .select(F.explode("r.scopeSpans").alias("s"))
        .select(F.explode("s.spans").alias("x"))
    )
    value = lambda a: F.struct(a["key"], F.coalesce(a["value"]["stringValue"], a["value"]["intValue"]))
    start, end = F.col("x.startTimeUnixNano").cast("decimal(20,0)"), F.col("x.endTimeUnixNano").cast("decimal(20,0)")
    attributes = F.map_from_entries(F.transform(F.coalesce("x.attributes", F.array()), value))
    return spans.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.col("x.name").alias("name"), F.when(end >= start, ((end - start) / 1_000_000).cast("double")).alias("duration_ms"), attributes.alias("attributes"),
    )


def openapi(files: DataFrame) -> DataFrame:
    """Operations: ``file``, ``method``, ``path`` (base path included), ``operation_id``, ``params``, ``auth_required`` (null: not said)."""
    spec = files.select(F.col("path").alias("file"), F.from_json("body", _OPENAPI).alias("j"))
    base = F.coalesce("j.basePath", F.regexp_replace(F.col("j.servers")[0]["url"], "^[a-z]+://[^/]+", ""), F.lit(""))
    items = spec.select("file", F.col("j.security").alias("common"), F.rtrim(base, F.lit("/")).alias("base"), F.explode("j.paths").alias("route", "item"))
    ops = items.select("file", "common", "base", "route", F.explode("item").alias("verb", "op")).filter(F.col("verb").isin(METHODS))
    parsed = ops.withColumn("o", F.from_json("op", _OPERATION))
    security = F.coalesce("o.security", "common")
    return parsed.select(
        "file", F.upper("verb").alias("method"), F.concat("base", "route").alias("path"), F.col("o.operationId").alias("operation_id"),
        F.coalesce(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col("o.parameters")["name"], F.array()), fn.path_params(F.col("route"))))), F.array()).alias("params"),
        F.when(security.isNotNull(), F.size(security) > 0).alias("auth_required"),
    )


def joern(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and findings of JSON-lines files of three kinds of records.

    A node may carry its edges as a map from a label to the edges that leave it (``outE``, each with the ``inV`` it enters); they are edges like others."""
    leaving = "outE map<string,array<struct<id:string,inV:string>>>"
    rows = spark.read.schema(f"kind string, id string, label string, source string, target string, rule string, line int, {leaving}").json(path)
    nodes = rows.filter("kind = 'node'")
    edges = rows.filter("kind = 'edge'").select("source", "target", "label")
    inner = nodes.select(F.col("id").alias("source"), F.explode("outE").alias("label", "es")).select("source", "label", F.explode("es").alias("e"))
    edges = edges.union(inner.filter("e.inV is not null").select("source", F.col("e.inV").alias("target"), "label"))
    return nodes.select("id", "label"), edges, rows.filter("kind = 'finding'").select("rule", "id", "line")


def case_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of benchmark cases: four columns, ``#`` comments; a row of another shape or a case named twice is an error."""
    rows = spark.read.option("comment", "#").option("mode", "FAILFAST").schema("name string, category string, positive boolean, cwe int").csv(path)
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.assert_true(F.col("n") == 1, "a case is named twice"))
    return rows.join(twice.filter("ok is null").select("name"), "name", "left_semi")


def shaped(value: Column, pattern: str) -> Column:
    """The value where it has the shape, else null."""
    return F.when(value.rlike(pattern), value)


_PARAMETER = "struct<name:string,`in`:string,`$ref`:string>"
_CONTRACT = f"""struct<openapi:string,swagger:string,security:array<map<string,array<string>>>,paths:map<string,map<string,string>>,
  parameters:map<string,{_PARAMETER}>,components:struct<parameters:map<string,{_PARAMETER}>>>"""
#: How many references may lead to a parameter.
MAX_REFS = 12


def contract(files: DataFrame) -> DataFrame:
    """Operations of Swagger 2.0 and OpenAPI 3 documents: ``file``, ``method``, ``route``, ``params`` (``in:name``, sorted), ``security``, ``twice``.

    Parameters of the path item and of the operation, references inside the document followed (others give none).  ``security`` is ``undeclared``, ``none``,
    ``optional`` or ``required``; ``twice`` tells that another operation has the method and the template, parameters' names aside."""
    version = F.coalesce("j.openapi", "j.swagger")
    spec = files.select(F.col("path").alias("file"), F.from_json("body", _CONTRACT).alias("j")).filter(version.rlike(r"^(2\.0|3\.[012]\.[0-9]+)$"))
    empty = F.create_map().cast(f"map<string,{_PARAMETER}>")
    keyed = lambda column, start: F.transform_keys(F.coalesce(column, empty), lambda k, _: F.concat(F.lit(start), k))
    shared = F.map_concat(keyed("j.parameters", "#/parameters/"), keyed("j.components.parameters", "#/components/parameters/"))
    items = spec.select("file", F.col("j.security").alias("common"), shared.alias("shared"), F.explode("j.paths").alias("route", "item")).filter(F.startswith("route", F.lit("/")))
    ops = items.select("*", F.explode("item").alias("verb", "op")).filter(F.col("verb").isin(METHODS))
    read = ops.withColumns({
        "o": F.from_json("op", f"struct<parameters:array<{_PARAMETER}>,security:array<map<string,array<string>>>>"),
        "p": F.from_json(F.try_element_at("item", F.lit("parameters")), f"array<{_PARAMETER}>"),
    })
    none = F.array().cast(f"array<{_PARAMETER}>")

    def followed(p: Column) -> Column:
        hops = F.sequence(F.lit(1), F.lit(MAX_REFS))
        return F.aggregate(hops, p, lambda at, _: F.when(at["$ref"].isNotNull(), F.try_element_at(F.col("shared"), at["$ref"])).otherwise(at))

    every = F.filter(F.transform(F.concat(F.coalesce("p", none), F.coalesce("o.parameters", none)), followed), lambda p: p["name"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(every, lambda p: F.concat_ws(":", p["in"], p["name"]))))
    wanted = F.coalesce("o.security", "common")
    state = F.when(wanted.isNull(), "undeclared").when(F.size(wanted) == 0, "none").when(F.exists(wanted, lambda s: F.size(s) == 0), "optional").otherwise("required")
    rows = read.select("file", F.upper("verb").alias("method"), "route", names.alias("params"), state.alias("security"), fn.canonical_template(F.col("route")).alias("_t"))
    same = rows.groupBy("file", "method", "_t").agg((F.count(F.lit(1)) > 1).alias("twice"))
    return rows.join(same, ["file", "method", "_t"]).drop("_t")
