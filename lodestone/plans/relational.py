"""Grouped and filtered queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query


@query(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_quantity) AS sum_qty
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_pricing_summary(t):
    return (
        t.lineitem
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"))
    )
