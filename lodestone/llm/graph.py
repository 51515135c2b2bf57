"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``num``, ``root`` (the least of its component) of every node with an edge, from edges ``a``, ``b`` (longs).

    Alternating star contraction: each round ties a node's larger neighbours, then its smaller ones, to the least
    of all, by aggregations and equi-joins.  Every round is written, so lost executors cost a round at most; the number
    of rounds grows with the logarithm of a component's size."""
    down = lambda e: e.filter("u != v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    held = written(spark, down(edges.selectExpr("a AS u", "b AS v")), "edges")
    seen = None
    while True:
        state = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = held.union(held.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = down(both.filter("v > u").join(least, "u").selectExpr("v AS u", "m AS v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
        held = written(spark, down(small), "edges")
    roots = held.select(F.col("v").alias("num")).distinct()
    return held.selectExpr("u AS num", "v AS root").union(roots.selectExpr("num", "num AS root"))
