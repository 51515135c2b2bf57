"""What defends a flow: who asks for an identity above it, how its query is built, what checks its input on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import nearest_origin
from lodestone.operators.storage import written

# What stands in a query's text for a bound value.
PLACEHOLDERS = ("?", "%s", "$1", ":param", "%(", "${}")
SQL = "sql_query"


def _holds(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def guards(functions: DataFrame, calls: DataFrame, edges: DataFrame, auth: Sequence[str]) -> DataFrame:
    """``fn``, ``auth`` (``decorator``, ``call_chain``, ``function_call``), ``auth_by``, ``auth_fn`` of the functions that are guarded.

    A function's own decorator comes first; then the nearest of the functions that lead to it which has a decorator or makes a call that asks for an identity, the least of equally near ones, and of what that has its decorator.
    A call of the function itself does not count.  ``functions``: ``fn``, ``decorators``; ``calls``: ``fn``, ``text``; ``edges``: ``src``, ``dst``.  The search is one row a function."""
    marks = F.filter("decorators", lambda d: _holds(d, auth))
    own = functions.select("fn", F.get(marks, 0).alias("by")).filter("by IS NOT NULL").groupBy("fn").agg(F.min("by").alias("by"))
    asks = calls.filter(_holds(F.col("text"), [w.lstrip("@") for w in auth])).groupBy("fn").agg(F.min("text").alias("said"))
    able = written(own.join(asks, "fn", "full"), "guards")
    links = written(edges.select("src", "dst").dropna().distinct(), "links")
    near = nearest_origin(links, able.select(F.col("fn").alias("origin"), F.col("fn").alias("node")))
    above = links.join(near.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("fn")).agg(F.min(F.struct("dist", "origin")).alias("n"))
    chain = above.select("fn", F.col("n.origin").alias("auth_fn")).join(able.select(F.col("fn").alias("auth_fn"), F.col("by").alias("above_by"), "said"), "auth_fn")
    both = chain.join(own, "fn", "full")
    return both.select(
        "fn", F.when(F.col("by").isNotNull(), "decorator").when(F.col("above_by").isNotNull(), "call_chain").otherwise("function_call").alias("auth"),
        F.coalesce("by", "above_by", "said").alias("auth_by"), F.when(F.col("by").isNotNull(), F.col("fn")).otherwise(F.col("auth_fn")).alias("auth_fn"),
    )


def defences(flows: DataFrame, functions: DataFrame, calls: DataFrame, edges: DataFrame, auth: Sequence[str], sanitizers: Sequence[str]) -> DataFrame:
    """``flows`` with ``auth``, ``auth_by``, ``auth_fn`` (as in ``guards``, by the sink's function), ``query`` (``parameterized``: a placeholder among the arguments of a call on the sink's line;
    ``prepared_statement``: a call that prepares, above it in its function) and ``checked_by`` (the first call between source and sink in the source's function whose text holds a sanitizer).

    ``flows``: distinct rows with ``file_path``, ``source_fn``, ``source_line``, ``sink_fn``, ``sink_line``, ``sink_type``, ``sanitized``; a sanitized one is not looked into.  ``calls``: ``fn``, ``file_path``, ``line``, ``text``, ``arguments``."""
    bound = calls.filter(F.exists("arguments", lambda a: _holds(a, PLACEHOLDERS))).select("file_path", F.col("line").alias("sink_line")).distinct().withColumn("_bound", F.lit(True))
    ready = calls.filter(F.contains(F.lower("text"), F.lit("prepare"))).groupBy(F.col("fn").alias("sink_fn")).agg(F.min("line").alias("_ready"))
    checks = calls.filter(_holds(F.lower("text"), [s.lower() for s in sanitizers])).select(F.col("fn").alias("source_fn"), "file_path", "line", "text")
    held = written(flows.withColumn("_id", F.monotonically_increasing_id()), "flows")
    open_ = held.filter("NOT sanitized")
    met = open_.join(checks, ["source_fn", "file_path"]).filter("line BETWEEN source_line AND sink_line")
    met = met.groupBy("_id").agg(F.min(F.struct("line", "text")).alias("c")).select("_id", F.col("c.text").alias("checked_by"))
    found = held.join(guards(functions, calls, edges, auth).withColumnRenamed("fn", "sink_fn"), "sink_fn", "left").join(bound, ["file_path", "sink_line"], "left").join(ready, "sink_fn", "left").join(met, "_id", "left")
    looked = ~F.col("sanitized")
    sql = looked & (F.col("sink_type") == SQL)
    query = F.when(sql & F.col("_bound"), "parameterized").when(sql & (F.col("_ready") < F.col("sink_line")), "prepared_statement")
    return found.select(*flows.columns, *(F.when(looked, F.col(c)).alias(c) for c in ("auth", "auth_by", "auth_fn")), query.alias("query"), "checked_by")
