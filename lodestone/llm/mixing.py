"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of its source.  Within
a source the documents are put in an order, their expected copies are prefix-summed, one random offset
is added, and a document is emitted once for each integer that its part of the sum crosses.  So a
source's documents number what its target asks for to within one, and no document exceeds the
expected copies rounded up.  The order runs over sizes (octaves, cut in eight), then over a hash of the id: neighbours are
of one size, hence the taken words come near the target as well.

As the expected copies are alike within a source, the prefix sum is a rank times a step.  The rank is
counted in three levels, so that no source, and no size within a source, is handled by one task:
documents within (source, size step, hash bucket), buckets within (source, size step), steps within a
source.  The number of hash buckets grows with the table.  Steps and offsets are integers in units of
2^-24, so a rerun and any other engine agree to the copy.

Targets: the sources by code point, null last, take the weights in turn; together they get ``share``
times the size of everything; a target stops at ``cap`` times its source's size and the excess goes to
the others by weight until none is above.  In closed form: sources sorted by cap * size / weight are
full up to some place, all later ones share the rest by weight.

Defined results: a null text has size 0, a very long one counts whole; null ids are one id, repeated rows are separate documents;
documents of size 0 count as documents of their source and take 0 words; a source with no words has
target 0 and no copies; an empty table gives an empty table; columns other than the id, text and source are not carried by
``mix`` (``mixed_rows`` repeats whole rows, in a table of its own names).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import n_words, written

UNIT = 24
#: Rows that a hash bucket holds of any one source and size step, about, at most.
BUCKET_ROWS = 65_536
LEAST_BUCKET_BITS = 6


def _hash(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def size_step(size: str) -> Column:
    """The octave of a size and its eighth within that octave, as one ascending number."""
    return F.expr(f"length(bin({size})) * 16 + shiftright({size}, greatest(length(bin({size})) - 4, 0))")


def targets(sized: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """A row per source: ``source``, ``source_size``, ``target``, ``step`` (expected copies in units of 2^-24), ``shift``."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(filling), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0))),
        )
        .withColumn("shared", F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("level") >= F.col("full_at"), F.col("most"))
            .otherwise(F.col("shared") * F.col("weight"))
            .alias("target"),
        )
        .withColumn(
            "step",
            F.when(
                F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * (1 << UNIT)).cast("long")
            ).otherwise(F.lit(0).cast("long")),
        )
        .withColumn("shift", _hash(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")), 6))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per document: ``doc_id``, ``group`` (its source, marked), ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    spark = docs.sparkSession
    sized = written(
        spark,
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
        ),
        "mix-sizes",
    )
    total = sized.count()
    bits = max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, total) / BUCKET_ROWS)) if total else 0)
    keyed = sized.select(
        "doc_id",
        "size",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")).alias("group"),
        size_step("size").alias("place"),
        F.coalesce(_hash(F.col("doc_id").cast("string"), 15), F.lit(0)).alias("key"),
    ).withColumn("bucket", F.shiftright("key", 60 - bits))

    cells = keyed.groupBy("group", "place", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    places = (
        cells.groupBy("group", "place")
        .agg(F.sum("n").alias("n"))
        .select("group", "place", F.coalesce(F.sum("n").over(before("group", "place")), F.lit(0)).alias("earlier"))
    )
    starts = (
        cells.withColumn("within", F.coalesce(F.sum("n").over(before("group", "place", "bucket")), F.lit(0)))
        .join(places, ["group", "place"])
        .select("group", "place", "bucket", (F.col("within") + F.col("earlier")).alias("start"))
    )
    own = Window.partitionBy("group", "place", "bucket").orderBy("key", "doc_id", "size")
    ranked = (
        keyed.withColumn("own", F.row_number().over(own))
        .join(starts, ["group", "place", "bucket"])
        .withColumn("rank", F.col("own") + F.col("start"))
    )
    goals = targets(sized, weights, share, cap).withColumn(
        "group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))
    )
    crossed = lambda rank: F.shiftright(rank * F.col("step") + F.col("shift"), UNIT)
    return (
        ranked.drop("source")
        .join(goals.drop("source"), "group")
        .withColumn("copies", (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("long"))
        .select(
            "doc_id", "group", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
        )
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as in ``docs``.

    Rows that share an id, a size and a source are alike to the mix; they are dealt their copies in the order of a
    hash of the row, so that reruns agree."""
    names = docs.columns
    alike = ["_id", "_size", "_group"]
    group = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("none"))
    copies = (
        mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
        .select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("group").alias("_group"), "copies")
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy("copies")))
    )
    keyed = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"),
        F.col(id_col).alias("_id"),
        n_words(F.col(text_col)).alias("_size"),
        group(F.col(source_col)).alias("_group"),
    ).withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64("_row"))))
    same = [keyed[c].eqNullSafe(copies[c]) for c in [*alike, "_nth"]]
    return (
        keyed.join(copies.filter("copies > 0"), same)
        .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("_row.*")
    )
