"""Declarative rules over lines of source, evaluated as column expressions and joins.

A rule names what to match, what excuses a match, and how far apart its parts may be; a set of rules is one pass over the lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineRule:
    """A line that matches ``pattern`` is a finding unless ``excused`` matches it as well; ``required`` has to match too."""

    rule_id: str
    pattern: str
    excused: str | None = None
    required: str | None = None
    severity: str = "medium"
    message: str = "match in {file}"


def evaluate(lines: DataFrame, rules: Sequence[LineRule], code: str = "code") -> DataFrame:
    """The lines with ``rule_id``, ``severity`` and ``message`` of each rule that fires; one pass, one row for each firing."""
    found = []
    for r in rules:
        hit = F.col(code).rlike(r.pattern)
        if r.excused:
            hit &= ~F.col(code).rlike(r.excused)
        if r.required:
            hit &= F.col(code).rlike(r.required)
        said = F.replace(F.lit(r.message), F.lit("{file}"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
        found.append(F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), said.alias("message"))))
    fired = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return lines.select("*", fired.alias("_f")).select(*lines.columns, "_f.rule_id", "_f.severity", "_f.message")


def sequences(lines: DataFrame, key: str, line: str, first: Column, then: Column, within: int, unless: Column | None = None) -> DataFrame:
    """Pairs (``first_line``, ``then_line``) of one key: ``then`` matches at most ``within`` lines after ``first``, with no ``unless`` between.

    The latest ``first`` before each line and the latest ``unless`` are running maxima, so no pairs are formed."""
    over = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select(
        key,
        line,
        then.alias("_then"),
        F.max(F.when(first, F.col(line))).over(over).alias("first_line"),
        (F.max(F.when(unless, F.col(line))).over(over) if unless is not None else F.lit(None).cast("int")).alias("_unless"),
    )
    kept = marked.filter("_then and first_line is not null").filter(F.col(line) - F.col("first_line") <= within)
    return kept.filter("_unless is null or _unless <= first_line").select(key, "first_line", F.col(line).alias("then_line"))


def blocks_without(lines: DataFrame, key: str, line: str, start: Column, end: Column, missing: Column) -> DataFrame:
    """Blocks from a ``start`` line up to the next ``end`` line in which ``missing`` does not match: ``block_start``, ``block_end``."""
    over = Window.partitionBy(key).orderBy(line)
    numbered = lines.select("*", F.count_if(start).over(over).alias("_block")).filter("_block > 0")
    inner = numbered.withColumn("_ended", F.coalesce(F.count_if(end).over(Window.partitionBy(key, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    body = inner.filter("_ended = 0").groupBy(key, "_block").agg(
        F.min(line).alias("block_start"), F.max(line).alias("block_end"), F.bool_or(end).alias("_closed"), F.bool_or(missing).alias("_found")
    )
    return body.filter("_closed and not _found").select(key, "block_start", "block_end")


def absent_before(lines: DataFrame, key: str, line: str, hit: Column, guard: Column, within: int) -> DataFrame:
    """``key``, ``line`` of lines that ``hit`` without a ``guard`` on any of the ``within`` lines before them.

    Guards are carried to the lines that they excuse, so it is an equi-join: a hot document is dealt out by its lines."""
    excused = lines.filter(guard).select(key, F.explode(F.sequence(F.col(line) + 1, F.col(line) + within)).alias(line)).distinct()
    return lines.filter(hit).select(key, line).join(excused, [key, line], "left_anti")


def snippets(lines: DataFrame, hits: DataFrame, key: str, line: str, code: str, context: int) -> DataFrame:
    """``hits`` (``key``, ``line``, distinct) with ``snippet``, the text from ``context`` lines before to as many behind, and ``start``, its first line.

    Each hit asks for its lines by number, so nothing sorts a whole document."""
    asked = hits.select(key, line).distinct().select(key, F.col(line).alias("_hit"), F.explode(F.sequence(F.greatest(F.col(line) - context, F.lit(1)), F.col(line) + context)).alias(line))
    found = asked.join(lines.select(key, line, code), [key, line]).groupBy(key, "_hit").agg(F.array_sort(F.collect_list(F.struct(line, code))).alias("_of"))
    return found.select(key, F.col("_hit").alias(line), F.array_join(F.col(f"_of.{code}"), "\n").alias("snippet"), F.get("_of", 0)[line].alias("start"))
