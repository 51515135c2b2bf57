"""Caps on what patterns may find in a file, as a fold over the patterns in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.findings import first_of

#: Findings of a rule in a file; once a pattern over source text has run, fewer, and of one such pattern no more.
MOST = 5
MOST_OF_SOURCE = 2


def folded(patterns: DataFrame, matches: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matches that are findings, and gaps: ``rule_id``, ``file_path``, ``cap``, ``omitted`` (matches of patterns that ran), ``not_run`` (patterns that did not).

    ``patterns``: ``rule_id``, ``file_path``, ``pattern`` (its place), ``source`` (whether over text), a row for each pattern that applies to the file, with matches or without; ``matches``: ``rule_id``,
    ``file_path``, ``pattern`` and the columns of ``order``.  Patterns run one after the other: what one finds is added, one over text first brings the cap down, and when the cap is reached the others don't
    run.  So a pattern without any match may still lower the cap for all before it.

    Of each pattern only the first few matches are kept before rows of a file meet; the fold itself is over counts, one array of a rule's patterns."""
    keys = ["rule_id", "file_path"]
    counts = matches.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n"))
    per = patterns.select(*keys, "pattern", "source").distinct().join(counts, [*keys, "pattern"], "left")
    given = F.least(F.coalesce("n", F.lit(0).cast("long")), F.when(F.col("source"), MOST_OF_SOURCE).otherwise(MOST).cast("long"))
    runs = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pattern", "source", given.alias("given"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("runs"))

    def step(state, p):
        cap = F.when(p["source"], F.least(state["cap"], F.lit(MOST_OF_SOURCE))).otherwise(state["cap"])
        n = state["n"] + p["given"]
        after = F.struct(n.alias("n"), cap.alias("cap"), (state["all"] + p["n"]).alias("all"), (state["ran"] + 1).alias("ran"), p["pattern"].cast("long").alias("last"), (n >= cap).alias("over"))
        return F.when(state["over"], state).otherwise(after)

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(MOST).alias("cap"), F.lit(0).cast("long").alias("all"), F.lit(0).alias("ran"), F.lit(-1).cast("long").alias("last"), F.lit(False).alias("over"))
    ended = runs.select(*keys, F.size("runs").alias("_all"), F.aggregate("runs", zero, step).alias("s"))
    first = first_of(matches, [*keys, "pattern"], order, MOST).join(patterns.select(*keys, "pattern", F.col("source").alias("_source")).distinct(), [*keys, "pattern"])
    text = first_of(first.filter("_source"), [*keys, "pattern"], order, MOST_OF_SOURCE)
    ran = first.filter("NOT _source").unionByName(text).join(ended.select(*keys, "s.cap", "s.last"), keys).filter("pattern <= last")
    caps = [ran.filter(F.col("cap") == c) for c in (MOST, MOST_OF_SOURCE)]
    kept = [first_of(rows, keys, ["pattern", *order], c) for rows, c in zip(caps, (MOST, MOST_OF_SOURCE), strict=True)]
    gaps = ended.select(*keys, "s.cap", (F.col("s.all") - F.least("s.n", F.col("s.cap").cast("long"))).alias("omitted"), (F.col("_all") - F.col("s.ran")).alias("not_run"))
    return kept[0].unionByName(kept[1]).select(*matches.columns), gaps.filter("omitted > 0 OR not_run > 0")
