"""Detection quality: confusion counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fn


def confusion(rows: DataFrame, by: list[str], positive: Column, detected: Column) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count_if(positive & detected).alias("tp"),
        F.count_if(~positive & detected).alias("fp"),
        F.count_if(positive & ~detected).alias("fn"),
        F.count_if(~positive & ~detected).alias("tn"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """Ratios of ``tp``, ``fp``, ``fn``, ``tn``, to six digits; null where the denominator is 0."""
    tp, fp, fneg, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = fn.safe_ratio(tp, tp + fneg), fn.safe_ratio(tn, tn + fp)
    low, high = fn.wilson(tp, tp + fneg)
    made = {
        "precision": fn.safe_ratio(tp, tp + fp), "recall": recall, "f1": fn.safe_ratio(2 * tp, 2 * tp + fp + fneg),
        "accuracy": fn.safe_ratio(tp + tn, tp + fp + fneg + tn), "fpr": fn.safe_ratio(fp, fp + tn), "balanced": (recall + specificity) / 2,
        "mcc": fn.safe_ratio(tp * tn - fp * fneg, F.sqrt((tp + fp) * (tp + fneg) * (tn + fp) * (tn + fneg))),
        "recall_low": low, "recall_high": high,
    }
    return counts.select("*", *(F.round(c, 6).alias(n) for n, c in made.items()))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, median (of the two middle values the mean), nearest-rank 95th percentile and greatest."""
    return rows.groupBy(*by).agg(
        F.min(value).alias("least"),
        F.round(F.percentile(value, 0.5), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
        F.max(value).alias("most"),
    )


def by_channel(rows: DataFrame, channel: str, kind: str, positive: Column, detected: Column) -> DataFrame:
    """Confusion counts of each channel, and of each channel and kind (``kind`` null: all); one aggregate over both groupings."""
    sets = rows.select(channel, positive.alias("_p"), detected.alias("_d"), F.explode(F.array(F.struct(F.col(kind).alias("k"), F.lit(False).alias("whole")), F.struct(F.lit(None).cast(rows.schema[kind].dataType).alias("k"), F.lit(True).alias("whole")))).alias("_g"))
    counted = confusion(sets.select(channel, "_p", "_d", F.col("_g.k").alias(kind), F.col("_g.whole").alias("_whole")), [channel, kind, "_whole"], F.col("_p"), F.col("_d"))
    return counted.drop("_whole")


def outcome(positive: Column, detected: Column) -> Column:
    return F.when(detected, F.when(positive, "TP").otherwise("FP")).otherwise(F.when(positive, "FN").otherwise("TN"))


def transitions(rows: DataFrame, positive: Column, before: Column, after: Column) -> DataFrame:
    """``transition`` (``FN->TP`` and so on), ``n``, ``kind``: ``same``, ``improvement`` (it is right now) or ``regression``."""
    a, b = outcome(positive, before), outcome(positive, after)
    counts = rows.groupBy(a.alias("_a"), b.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("_a") == F.col("_b"), "same").when(F.col("_b").isin("TP", "TN"), "improvement").otherwise("regression")
    return counts.select(F.concat("_a", F.lit("->"), "_b").alias("transition"), "n", kind.alias("kind"))
