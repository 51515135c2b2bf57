"""Filtering, ranking, deduplication and capping of findings, and the roll-ups over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The severities in the order of their rank.
SEVERITIES = ["critical", "high", "medium", "low"]
# Roles in the order of their rights.
ROLES = ["viewer", "triager", "maintainer", "admin"]
#: What makes a row of findings unique; every ranking ends in it.
ROW = ["scan_id", "k_line", "k_part", "k_supp", "k_price"]


def ordinal(value: Column, domain: Sequence[str]) -> Column:
    """The place of a value in its domain, beyond it for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, domain)), value), F.lit(0)) - 1, F.lit(len(domain))).cast("int")


def above_threshold(findings: DataFrame, severity: str = "medium", confidence: float = 0.3, generated: Sequence[str] = ()) -> DataFrame:
    """Findings of at least a severity and a confidence, outside generated paths."""
    kept = findings.filter((ordinal(F.col("severity"), SEVERITIES) <= SEVERITIES.index(severity)) & (F.col("confidence") >= confidence))
    for part in generated:
        kept = kept.filter(~F.col("file_path").contains(part))
    return kept


def blocking_first() -> Column:
    return F.when(F.col("disposition") == "blocking", 0).otherwise(1)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.  The limit on the row number lets Spark cut each key before the shuffle, so a hot key is cheap."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def occurrences(findings: DataFrame) -> DataFrame:
    """One finding for each (rule, file, start, end): blocking first, then the most confident, then the first."""
    return first_of(findings, ["rule_id", "file_path", "line_start", "line_end"], [blocking_first(), F.desc("confidence"), *ROW])


def _with_starts(ranged: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row beside its range's ``_start``; null keys are a key of their own."""
    named = starts.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate([*keys, "_range"])), "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate([*keys, "_range"])]
    return ranged.join(named, same).drop(*(f"_of_{i}" for i in range(len(same))))


def numbered(rows: DataFrame, keys: Sequence[str], first: str, width: int, order: Sequence[Column | str], name: str) -> DataFrame:
    """Row numbers within each key, in ``order``, which begins with the number ``first``.

    Rows are counted in ranges of ``width`` of ``first``, the counts are summed up, and a task only sorts one range: a hot key is spread."""
    ranged = rows.withColumn("_range", F.floor(F.col(first) / width))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    placed = _with_starts(ranged.withColumn("_own", own), starts, keys)
    return placed.withColumn(name, F.col("_own") + F.col("_start")).drop("_range", "_own", "_start")


def ordered(rows: DataFrame, ranks: Sequence[str], score: str, width: int, name: str) -> DataFrame:
    """Numbers all rows by ``ranks``, then ``score`` downwards, then ``ROW``; one task orders a range of ``width`` scans of one (ranks, score) at most."""
    cell = [*ranks, score]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*ranks, F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_of_{c}") for c in cell), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = numbered(rows, cell, ROW[0], width, ROW, name)
    placed = own.join(starts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell])
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_before", *(f"_of_{c}" for c in cell))


def running_sum(rows: DataFrame, keys: Sequence[str], first: str, width: int, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to each row of its key by the number ``first``, rows of one number together; spread like ``numbered``.

    Null until there is a value; a null key is a key of its own."""
    ranged = rows.withColumns({"_range": F.floor(F.col(first) / width), "_value": value})
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_range", F.sum("_sum").over(before).alias("_start"))
    own = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(first))
    placed = _with_starts(ranged.withColumn("_own", own), starts, keys)
    return placed.withColumn(name, F.coalesce(F.col("_own") + F.col("_start"), "_own", "_start")).drop("_range", "_value", "_own", "_start")


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key, each with ``omitted``, the number of the key's other rows."""
    totals = rows.groupBy(*keys).agg((F.count(F.lit(1)) - n).alias("omitted"))
    return first_of(rows, keys, order, n).join(totals, list(keys)).withColumn("omitted", F.greatest("omitted", F.lit(0)))


def counts_over(rows: DataFrame, by: str, domain: Sequence[str]) -> DataFrame:
    """A count for each value of the domain, zero where there is none."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(d,) for d in domain], f"{by} string")
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def visible(rows: DataFrame, members: DataFrame, user: int | None, least: str = "viewer", admin: bool = False) -> DataFrame:
    """Rows of projects in which ``user`` has at least a role; all for an admin, none for nobody."""
    if admin:
        return rows
    if user is None:
        return rows.filter(F.lit(False))
    allowed = members.filter((F.col("user_id") == user) & (ordinal(F.col("role"), ROLES) >= ROLES.index(least)))
    return rows.join(allowed.select("project_id").distinct(), "project_id", "left_semi")


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, each with the ``total``."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def after(rows: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """Up to ``size`` rows behind the cursor; ``more`` says whether there are others."""
    found = rows.filter(F.col(key) > cursor).orderBy(key).limit(size + 1)
    marked = found.withColumn("_nth", F.row_number().over(Window.orderBy(key))).withColumn("more", F.max("_nth").over(Window.partitionBy()) > size)
    return marked.filter(F.col("_nth") <= size).drop("_nth")


def gate(scans: DataFrame, findings: DataFrame, severities: Sequence[str]) -> DataFrame:
    """``scan_id``, ``exit_code`` of every scan: 2 if it did not end, 3 if it covers only a part, 1 if it has a blocking finding of one of the severities, else 0."""
    blocked = findings.filter((F.col("disposition") == "blocking") & F.col("severity").isin(*severities)).select("scan_id").distinct().withColumn("_blocked", F.lit(True))
    code = F.when(~F.coalesce(F.col("status").isin("completed", "partial"), F.lit(False)), 2).when(F.col("status") == "partial", 3).when(F.col("_blocked"), 1).otherwise(0)
    return scans.join(blocked, "scan_id", "left").select("scan_id", code.alias("exit_code"))


def budgeted_batches(rows: DataFrame, key: str, order: Sequence[str], size: int, cost: str, budget: int) -> DataFrame:
    """Batches of ``size`` rows of a key in their order: ``key``, ``batch``, ``cost``, ``run``: whether all batches up to this one fit the budget."""
    placed = numbered(rows, [key], order[0], 4096, list(order), "_nth")
    batches = placed.groupBy(key, F.floor((F.col("_nth") - 1) / size).alias("batch")).agg(F.sum(cost).alias("cost"))
    return running_sum(batches, [key], "batch", 1024, F.col("cost"), "_upto").select(key, "batch", "cost", (F.col("_upto") <= budget).alias("run"))
