"""Attack surface: client calls against endpoints, directly, by templates and through gateways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fn


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``call_id``, ``path`` (the endpoint's), ``how``: ``exact``, else ``template``.

    ``calls``: ``call_id``, ``method``, ``client_path``; ``endpoints``: ``method``, ``path``.  Exact matches are an equi-join.  A
    template joins on its number of segments and its first segment, or on the number alone if that segment is a parameter; then
    its regular expression decides."""
    served = endpoints.select("method", "path").distinct()
    fits = (F.col("method") == F.col("call_method")) | (F.col("method") == "ALL")
    asked = calls.select("call_id", F.col("method").alias("call_method"), fn.client_path(F.col("client_path")).alias("client_path"))
    exact = asked.join(served, asked["client_path"] == served["path"]).filter(fits).select("call_id", "path", F.lit("exact").alias("how"))
    templates = served.filter(F.contains("path", F.lit("{"))).select(
        "method", "path", fn.segments(F.col("path")).alias("n"), fn.first_literal(F.col("path")).alias("lead"), fn.template_regex(F.col("path")).alias("regex")
    )
    shaped = asked.withColumn("n", fn.segments(F.col("client_path"))).withColumn("lead", F.split_part("client_path", F.lit("/"), F.lit(2)))
    open_ = F.contains("lead", F.lit("{"))
    met = shaped.join(templates.filter(~open_), ["n", "lead"]).unionByName(shaped.join(templates.filter(open_).drop("lead"), "n"))
    loose = met.filter(fits & F.regexp_like("client_path", F.col("regex")))
    loose = loose.select("call_id", "path", F.lit("template").alias("how")).join(exact.select("call_id", "path"), ["call_id", "path"], "left_anti")
    return exact.union(loose).distinct()


def through_gateway(path: Column, strip: Column, prefix: Column) -> Column:
    """``strip`` leading segments go, then ``prefix`` comes before the rest."""
    rest = F.array_join(F.slice(F.split(path, "/"), strip + 2, F.size(F.split(path, "/"))), "/")
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit("/"), rest)


def apply_filters(path: Column, filters: Column) -> Column:
    """The path that a gateway's filters make of ``path``, one after the other; slashes collapse after each.

    ``filters``: an array of (``name``, ``args``).  ``StripPrefix`` takes leading segments off, ``PrefixPath`` puts some before, ``SetPath`` replaces
    the path, ``RewritePath`` replaces what its pattern (named groups too) matches.  Others, and those without arguments, leave the path as it is."""

    def step(acc: Column, f: Column) -> Column:
        name, first, second = F.lower(f["name"]), F.get(f["args"], 0), F.get(f["args"], 1)
        parts = F.split(F.ltrim(acc, F.lit("/")), "/")
        count = F.coalesce(first.try_cast("int"), F.lit(0))
        made = (
            F.when((name == "stripprefix") & first.rlike("^[0-9]+$"), F.concat(F.lit("/"), F.array_join(F.slice(parts, count + 1, F.size(parts)), "/")))
            .when((name == "prefixpath") & first.isNotNull(), F.concat(F.lit("/"), F.btrim(first, F.lit("/")), F.lit("/"), F.ltrim(acc, F.lit("/"))))
            .when((name == "setpath") & first.isNotNull(), first)
            .when((name == "rewritepath") & second.isNotNull(), F.regexp_replace(acc, first, second))
            .otherwise(acc)
        )
        return F.regexp_replace(made, "/{2,}", "/")

    return F.aggregate(filters, path, step)


def pattern_regex(pattern: Column) -> Column:
    """A regular expression for a route's pattern: ``{x}``, ``<x>`` and ``:x`` are one segment, ``**`` is any path, ``*`` is within a segment; a last slash is optional."""
    marked = F.regexp_replace(pattern, r"\{[^}]+\}|<[^>]+>|:[A-Za-z_]\w*", "\x01")
    bare = F.when(F.rtrim(marked, F.lit("/")) == "", "/").otherwise(F.rtrim(marked, F.lit("/")))
    quoted = F.regexp_replace(F.regexp_replace(bare, r"\*\*", "\x02"), r"([.+?^$()\[\]{}|\\])", r"\\$1")
    inner = F.replace(F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("\x02"), F.lit(".*")), F.lit("\x01"), F.lit("[^/]+"))
    return F.concat(F.lit("^"), inner, F.lit("/?$"))


def through_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``call_id``, ``method``, ``route_id``, ``client_path`` (what the route's filters make of the call's path) for each route that takes the call.

    ``calls``: ``call_id``, ``method``, ``client_path``; ``routes``: ``route_id``, ``methods`` (empty: all), ``patterns``, ``filters``.  A pattern is looked up by its first
    segment, or under one key for all if that is no literal, so calls meet the routes that can take them only."""
    lead = F.split_part(F.col("pattern"), F.lit("/"), F.lit(2))
    ways = routes.select("route_id", "methods", "filters", F.explode("patterns").alias("pattern"))
    ways = ways.select("route_id", "methods", "filters", pattern_regex(F.col("pattern")).alias("regex"), F.when(lead.rlike(r"[*{<:]") | (lead == ""), "*").otherwise(lead).alias("lead"))
    asked = calls.select("call_id", "method", fn.client_path(F.col("client_path")).alias("client_path"))
    asked = asked.withColumn("lead", F.explode(F.array_distinct(F.array(F.split_part("client_path", F.lit("/"), F.lit(2)), F.lit("*")))))
    concrete = F.regexp_replace("client_path", r"\{[^}]+\}", "value")
    met = asked.join(ways, "lead").filter(((F.size("methods") == 0) | F.array_contains("methods", F.col("method"))) & F.regexp_like(concrete, F.col("regex")))
    return met.select("call_id", "method", "route_id", apply_filters(F.col("client_path"), F.col("filters")).alias("client_path")).distinct()


def link(calls: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """``call_id``, ``repository_id``, ``method``, ``path``, ``how`` of every endpoint that a call meets: ``exact``, else ``template``, else ``gateway_transform``.

    A call meets an endpoint once; through a gateway it meets those at the path behind the route's filters."""
    served = endpoints.select("repository_id", "method", "path").distinct()
    direct = match_calls(calls, served)
    behind = match_calls(through_routes(calls, routes), served).select("call_id", "path", F.lit("gateway_transform").alias("how"))
    rank = F.when(F.col("how") == "exact", 0).when(F.col("how") == "template", 1).otherwise(2)
    best = direct.union(behind).groupBy("call_id", "path").agg(F.min(F.struct(rank.alias("r"), "how"))["how"].alias("how"))
    asked = calls.select("call_id", F.col("method").alias("_asked"))
    found = best.join(asked, "call_id").join(served, "path").filter((F.col("method") == F.col("_asked")) | (F.col("method") == "ALL"))
    return found.select("call_id", "repository_id", "method", "path", "how").distinct()


def observed(observations: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """Endpoints with ``observations``, the number of recorded requests that met them; zero for others.

    ``observations``: ``call_id``, ``method``, ``client_path``; those without a method or a path meet nothing."""
    seen = link(observations.filter("method is not null and client_path is not null"), endpoints, routes)
    counts = seen.groupBy("repository_id", "method", "path").agg(F.count_distinct("call_id").alias("_n"))
    keys = ["repository_id", "method", "path"]
    named = counts.select(*(F.col(c).alias(f"_{c}") for c in keys), "_n")
    same = [endpoints[c].eqNullSafe(named[f"_{c}"]) for c in keys]
    return endpoints.join(named, same, "left").select(endpoints["*"], F.coalesce("_n", F.lit(0)).alias("observations"))
