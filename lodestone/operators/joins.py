"""Joins that Spark has no single operator for: tiers, containment, nearest neighbours, overlaps, unique matches.

All are equi-joins on a key or on a key and a bucket of lines, so a hot file is dealt out by its lines; the best match is taken by
an aggregate, which Spark combines before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def unique_targets(candidates: DataFrame, keys: Sequence[str], target: str, name: str) -> DataFrame:
    """A row per key: the number of targets and the target if it is the only one."""
    found = candidates.groupBy(*keys).agg(F.count_distinct(target).alias(f"{name}_n"), F.min(target).alias("_one"))
    return found.select(*keys, f"{name}_n", F.when(F.col(f"{name}_n") == 1, F.col("_one")).alias(name))


def tiered(rows: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], target: str) -> DataFrame:
    """Looks each row up in tier after tier; the first tier that has the key decides, and if it has several targets the
    result is null: an ambiguous tier never falls through.

    ``tiers``: (name, table, key columns that rows and table share).  Adds ``tier`` and ``target``."""
    out, tier, value = rows, F.lit(None).cast("string"), F.lit(None)
    for name, table, keys in reversed(tiers):
        found = unique_targets(table, keys, target, f"_{name}")
        out = out.join(found, list(keys), "left")
        hit = F.col(f"_{name}_n").isNotNull()
        tier, value = F.when(hit, name).otherwise(tier), F.when(hit, F.col(f"_{name}")).otherwise(value)
    dropped = [c for name, _, _ in tiers for c in (f"_{name}", f"_{name}_n")]
    return out.withColumn("tier", tier).withColumn(target, value).drop(*dropped)


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET)))


def containing(points: DataFrame, intervals: DataFrame, key: str, line: str, out: Sequence[str]) -> DataFrame:
    """Each point with the columns ``out`` of the narrowest interval of its key that holds its line, null if none does.

    On equal widths the least ``out`` wins.  Intervals have ``line_start`` and ``line_end``; rows of points that are alike stay apart."""
    rows = points.select(key, line).distinct().withColumn("_bucket", F.floor(F.col(line) / BUCKET))
    spans = intervals.withColumn("_bucket", _buckets(F.col("line_start"), F.col("line_end"))).select(
        key, "_bucket", "line_start", "line_end", *out
    )
    hits = rows.join(spans, [key, "_bucket"]).filter((F.col(line) >= F.col("line_start")) & (F.col(line) <= F.col("line_end")))
    best = hits.groupBy(key, line).agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("width"), *out)).alias("_best"))
    return points.join(best, [key, line], "left").select(points["*"], *(F.col(f"_best.{c}").alias(c) for c in out))


def nearest(points: DataFrame, targets: DataFrame, key: str, line: str, target_line: str, target: str) -> DataFrame:
    """Each point's ``target`` at the least distance of lines, ties to the smaller line, then to the smaller target.

    Targets nearest before and after are carried over buckets of lines, so no task sorts a whole key."""
    place = targets.groupBy(key, F.col(target_line).alias("_at")).agg(F.min(target).alias("_target"))
    asked = points.select(key, F.col(line).alias("_line")).distinct()
    both = place.select(key, F.col("_at").alias("_line"), F.struct("_at", "_target").alias("_hit")).unionByName(
        asked.select(key, "_line", F.lit(None).cast(place.select(F.struct("_at", "_target").alias("h")).schema["h"].dataType).alias("_hit"))
    )
    both = both.withColumn("_bucket", F.floor(F.col("_line") / BUCKET))
    ends = both.filter("_hit is not null").groupBy(key, "_bucket").agg(F.min("_hit").alias("_first"), F.max("_hit").alias("_last"))
    blocks = both.select(key, "_bucket").distinct().join(ends, [key, "_bucket"], "left")
    over = Window.partitionBy(key).orderBy("_bucket")
    carried = blocks.select(
        key,
        "_bucket",
        F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inner = Window.partitionBy(key, "_bucket").orderBy("_line")
    seen = both.withColumn("_lower", F.last("_hit", True).over(inner.rangeBetween(Window.unboundedPreceding, 0))).withColumn(
        "_upper", F.first("_hit", True).over(inner.rangeBetween(0, Window.unboundedFollowing))
    )
    found = (
        seen.filter("_hit is null")
        .join(carried, [key, "_bucket"])
        .select(key, "_line", F.coalesce("_lower", "_before").alias("_lower"), F.coalesce("_upper", "_after").alias("_upper"))
    )
    down, up = F.col("_line") - F.col("_lower._at"), F.col("_upper._at") - F.col("_line")
    pick = F.when(F.col("_upper").isNull() | (down <= up), F.col("_lower")).otherwise(F.col("_upper"))
    chosen = found.select(key, F.col("_line").alias(line), pick.alias("_pick"))
    return points.join(chosen, [key, line], "left").select(points["*"], F.col("_pick._target").alias(target), F.abs(F.col(line) - F.col("_pick._at")).alias("distance"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of one key whose ranges of lines overlap; ``line_start``, ``line_end`` on the left, ``r_start``, ``r_end`` on the right.

    A pair meets in every bucket that both cover and is kept in the first of them."""
    a = left.withColumn("_bucket", _buckets(F.col("line_start"), F.col("line_end")))
    b = right.withColumn("_bucket", _buckets(F.col("r_start"), F.col("r_end")))
    first = F.greatest(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("r_start") / BUCKET))
    met = a.join(b, [key, "_bucket"])
    return met.filter((F.col("line_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("line_end")) & (F.col("_bucket") == first)).drop("_bucket")


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs in which either side has this candidate only; the others are for review: ``status``."""
    pairs = pairs.select(left, right).distinct()
    by_left = pairs.groupBy(left).agg(F.count(F.lit(1)).alias("_l"))
    by_right = pairs.groupBy(right).agg(F.count(F.lit(1)).alias("_r"))
    both = pairs.join(by_left, left).join(by_right, right)
    return both.select(left, right, F.when((F.col("_l") == 1) & (F.col("_r") == 1), "matched").otherwise("review").alias("status"))


def matched_lines(actual: DataFrame, expected: DataFrame, keys: Sequence[str], line: str, tolerance: int = 3) -> DataFrame:
    """The greatest one-to-one matching of actual and expected rows of one key that are at most ``tolerance`` lines apart: ``keys``, ``line``, how many
    of either are at the line (``actual``, ``expected``), and how many of them are matched (``actual_matched``, ``expected_matched``).

    In the order of the lines each actual row takes the first expected one in reach that is left.  Rows at one line are counted first, so
    a key has at most as many rows as its file has lines, and a key is parted wherever no two lines are within the tolerance.  Null lines match nothing and are left out."""
    if tolerance < 0:
        raise ValueError("the tolerance is negative")
    count = lambda rows, name: rows.select(*keys, F.col(line).cast("long").alias("line"), *(F.lit(int(n == name)).alias(n) for n in ("actual", "expected")))
    lines = count(actual, "actual").union(count(expected, "expected")).filter("line is not null").groupBy(*keys, "line")
    lines = lines.agg(F.sum("actual").alias("actual"), F.sum("expected").alias("expected"))
    over = Window.partitionBy(*keys).orderBy("line")
    far = F.coalesce(F.col("line") - F.lag("line").over(over) > tolerance, F.lit(False)).cast("long")
    parts = lines.withColumn("_far", far).withColumn("_part", F.sum("_far").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")
    both = parts.groupBy(*keys, "_part").agg((F.sum("actual") > 0).alias("_a"), (F.sum("expected") > 0).alias("_e"))
    parts = parts.join(both, [*keys, "_part"])
    alone = parts.filter("not (_a and _e)").select(*keys, "line", "actual", "expected", *(F.lit(0).cast("long").alias(f"{n}_matched") for n in ("actual", "expected")))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line").reset_index(drop=True)
        at, given, left = rows["line"].tolist(), rows["actual"].tolist(), rows["expected"].tolist()
        taken, first = [0] * len(at), 0
        for k, n in enumerate(given):
            while n and first < len(at) and at[first] <= at[k] + tolerance:
                if at[first] < at[k] - tolerance or not left[first]:
                    first += 1
                    continue
                m = min(n, left[first])
                n, taken[k], left[first] = n - m, taken[k] + m, left[first] - m
        rows["actual_matched"], rows["expected_matched"] = taken, rows["expected"] - left
        return rows[[*keys, "line", "actual", "expected", "actual_matched", "expected_matched"]]

    met = parts.filter("_a and _e").drop("_a", "_e")
    return alone.union(met.groupBy(*keys, "_part").applyInPandas(match, alone.schema))


#: Shares of a key's rows on the left.
SHARES = 64


def dealt_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of rows of one ``key``, where keys are few and their pairs many: the left rows are dealt into ``SHARES`` shares, and each meets all right rows.

    The tasks are as many as shares, whatever the rows weigh, since the pairs number more than they do."""
    share = F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(SHARES)).cast("int")
    dealt = left.withColumn("_share", share).repartition(SHARES, key, "_share")
    every = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(SHARES, key, "_share")
    return dealt.join(every, [key, "_share"]).drop("_share")
