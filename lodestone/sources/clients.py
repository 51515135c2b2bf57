"""HTTP calls of client code, and the routes of gateways, from sources and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.sources.endpoints import METHODS

#: The objects whose methods are HTTP calls, and how far behind a call its options are looked for.
CLIENTS = ("api", "apiclient", "axios", "httpclient", "this.http")
OPTIONS, CONFIG = 400, 1200
_STRING = r"""(?:"([^"]*)"|'([^']*)'|`([^`]*)`)"""
#: ``fetch(url``, ``client.verb(url`` and ``axios({``.
_CALL = rf"""\b(?:(fetch)\s*\(\s*{_STRING}|((?i:this\.http|[A-Za-z]+))\.((?i:{"|".join(METHODS)}))\s*\(\s*{_STRING}|(axios)\s*\(\s*\{{)"""


def _string(text: Column, pattern: str, first: int) -> Column:
    """What one of the three quotes of ``_STRING`` holds."""
    return F.concat(*(F.regexp_extract(text, pattern, first + k) for k in range(3)))


def _option(text: Column, name: str) -> Column:
    return F.nullif(_string(text, rf"""\b{name}\s*:\s*{_STRING}""", 1), F.lit(""))


def client_calls(files: DataFrame) -> DataFrame:
    """``file_path``, ``line``, ``method``, ``path``, ``client``, ``dynamic`` of the calls in ``files`` (``file_path``, ``language``, ``text``), each once.

    ``fetch`` and ``axios({...})`` take the method from their options, GET if there is none.  A path is what ``client_path`` makes of the url;
    urls without a path, and methods that HTTP does not have, are no calls.  One scan; the last step drops repeats within a file and line."""
    text = F.col("text")
    rows = files.filter(F.col("language").isin("javascript", "typescript") & text.isNotNull())
    whole = F.regexp_extract_all(text, F.lit(_CALL), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast("array<struct<end:int,line:int>>").alias("found"))
    breaks = lambda s: F.regexp_count(s, F.lit("\n")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        line = acc["line"] + breaks(x["before"])
        end = acc["at"] + F.length(x["before"]) + F.length(x["call"])
        return F.struct(end.alias("at"), (line + breaks(x["call"])).alias("line"), F.concat(acc["found"], F.array(F.struct(end.alias("end"), line.alias("line")))).alias("found"))

    pieces = F.arrays_zip(F.slice(F.split(text, _CALL, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("call"))
    placed = F.arrays_zip(whole.alias("call"), F.aggregate(pieces, start, step, lambda acc: acc["found"]).alias("place"))
    each = rows.select("file_path", "text", F.explode(placed).alias("c")).select("file_path", F.col("c.call").alias("call"), F.col("c.place.line").alias("line"), F.substring(text, F.col("c.place.end") + 1, F.lit(CONFIG)).alias("after"))
    call, part = F.col("call"), lambda k: F.regexp_extract("call", _CALL, k)
    config = F.regexp_extract("after", r"(?s)^(.*?)\}\s*\)", 1)
    kind = F.when(part(1) != "", "fetch").when(part(10) != "", "config").when(F.lower(part(5)).isin(*CLIENTS), "method")
    found = each.select(
        "file_path", "line", kind.alias("kind"),
        F.when(kind == "fetch", _string(call, _CALL, 2)).when(kind == "method", _string(call, _CALL, 7)).otherwise(_option(config, "url")).alias("url"),
        F.upper(F.when(kind == "method", part(6)).otherwise(F.coalesce(_option(F.when(kind == "fetch", F.substring("after", 1, OPTIONS)).otherwise(config), "method"), F.lit("GET")))).alias("method"),
        F.when(kind == "method", part(5)).when(kind == "fetch", "fetch").otherwise("axios").alias("client"),
    ).filter("kind is not null and url is not null")
    url = F.trim(F.regexp_replace("url", r"\$\{[^}]+\}", "{dynamic}"))
    # without an origin a path begins at the first slash
    rooted = F.when(F.contains(url, F.lit("://")) | F.startswith(url, F.lit("/")), url).otherwise(F.substring(url, F.nullif(F.instr(url, "/"), F.lit(0)), F.length(url)))
    path = F.nullif(fn.client_path(rooted), F.lit(""))
    path = F.coalesce(path, F.when(F.contains(url, F.lit("://")), "/"))
    calls = found.select("file_path", "line", "method", path.alias("path"), "client", F.contains("url", F.lit("${")).alias("dynamic"))
    return calls.filter(F.col("method").isin(*METHODS) & F.col("path").isNotNull()).dropDuplicates(["file_path", "line", "method", "path"])


FILTER = "struct<name:string,args:array<string>>"


def _filters(text: Column) -> Column:
    """``Name=a, b`` as (name, args); quotes and blanks around an argument go, and only the first comma of a rewrite parts its arguments."""
    name = F.trim(F.substring_index(text, "=", 1))
    rest = F.substring(text, F.instr(text, "=") + 1, F.length(text))
    cut = F.when(F.lower(name) == "rewritepath", F.split(rest, ",", 2)).otherwise(F.split(rest, ","))
    args = F.transform(cut, lambda a: F.trim(F.btrim(F.trim(a), F.lit("'\""))))
    return F.struct(name.alias("name"), F.when(F.contains(text, F.lit("=")), args).otherwise(F.array().cast("array<string>")).alias("args"))


def configured_routes(routes: DataFrame) -> DataFrame:
    """``repository_id``, ``route_id``, ``uri``, ``patterns``, ``methods``, ``filters`` of configured routes; of those that share repository, id and patterns the last counts.

    ``routes``: ``repository_id``, ``nth`` (the order), ``id``, ``uri``, ``predicates`` and ``filters``, arrays of ``Name=a,b``, as configuration files have them.
    Routes without a path are none; a missing id is ``route-`` and the order."""
    of = lambda name: F.flatten(F.transform(F.filter(F.coalesce("predicates", F.array().cast("array<string>")), lambda p: F.startswith(F.lower(p), F.lit(f"{name}="))), lambda p: _filters(p)["args"]))
    full = lambda a: F.filter(a, lambda x: x != "")
    named = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("route-"), F.col("nth").cast("string")))
    made = routes.select(
        "repository_id", "nth", named.alias("route_id"), F.coalesce("uri", F.lit("")).alias("uri"), full(of("path")).alias("patterns"),
        F.transform(full(of("method")), F.upper).alias("methods"), F.coalesce(F.transform("filters", _filters), F.array().cast(f"array<{FILTER}>")).alias("filters"),
    ).filter(F.size("patterns") > 0)
    last = made.groupBy("repository_id", "route_id", "patterns").agg(F.max_by(F.struct("uri", "methods", "filters"), "nth").alias("r"))
    return last.select("repository_id", "route_id", "patterns", "r.*")


#: A filter of a route in code; its arguments are quoted texts and numbers.
_FILTER = r"""\.(?:strip|set|rewrite|prefix)(?:Prefix|Path)\s*\(((?:"[^"]*"|'[^']*'|[^()"'])*)\)"""
_ROUTE = r"""\.route\s*\(\s*["']([^"']+)["']"""


def coded_routes(files: DataFrame) -> DataFrame:
    """``file_path``, ``route_id``, ``uri``, ``patterns``, ``filters`` of the routes that sources (``file_path``, ``language``, ``text``) build in Java or Kotlin.

    A route goes from its ``.route("id"`` to the next one; without a path or a uri it is none."""
    rows = files.filter(F.col("language").isin("java", "kotlin") & F.col("text").rlike(_ROUTE))
    bodies = F.arrays_zip(F.regexp_extract_all("text", F.lit(_ROUTE), F.lit(1)).alias("id"), F.slice(F.split("text", _ROUTE, -1), 2, F.size(F.regexp_extract_all("text", F.lit(_ROUTE), F.lit(0)))).alias("body"))
    each = rows.select("file_path", F.explode(bodies).alias("b")).select("file_path", F.col("b.id").alias("route_id"), F.col("b.body").alias("body"))
    calls = F.regexp_extract_all("body", F.lit(_FILTER), F.lit(0))
    filters = F.transform(calls, lambda c: _filters(F.concat(F.regexp_extract(c, r"\.(\w+)", 1), F.lit("="), F.regexp_extract(c, _FILTER, 1))))
    made = each.select("file_path", "route_id", F.regexp_extract("body", r"""\.uri\s*\(\s*["']([^"']+)["']""", 1).alias("uri"), F.regexp_extract_all("body", F.lit(r"""\.path\s*\(\s*["']([^"']+)["']"""), F.lit(1)).alias("patterns"), filters.alias("filters"))
    return made.filter((F.size("patterns") > 0) & (F.col("uri") != ""))
