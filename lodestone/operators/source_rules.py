"""Rules over whole source texts: matches that may run over lines, with their offsets, lines and columns.

A text is searched where it lies, in one pass for all rules; the starts of its lines are found once, and an offset's line is a binary search among them, so a long text costs what its
length and its matches cost.  Texts are not split into rows, and no match is dealt out before it is a finding."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Findings of a pattern in a segment, and of a rule in a file; characters before a definition's line in which its guard may stand.
MOST = 2
WINDOW = 500
FOUND = "rule_id string, segment int, line int, col int, start int, evidence string"


@dataclass(frozen=True)
class SourceRule:
    """With ``definition``: each match of it without ``guard`` in the ``WINDOW`` characters before the line above it.  Else: the matches of the first of ``primary``, if
    all others of these and all of ``required`` match the segment and none of ``excluded`` does.  ``within``: ``file`` or ``function``."""

    rule_id: str
    primary: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    within: str = "file"
    definition: str | None = None
    guard: str | None = None

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(offset, evidence) in a segment, ``MOST`` at most."""
        if self.definition:
            out = []
            for m in re.finditer(self.definition, text):
                above = max(0, text.rfind("\n", 0, max(0, m.start() - 1)) - WINDOW)
                if not re.search(self.guard, text[above : m.start()]):
                    out.append((m.start(), m[0]))
                    if len(out) == MOST:
                        break
            return out
        if not all(re.search(p, text) for p in (*self.required, *self.primary[1:])) or any(re.search(p, text) for p in self.excluded):
            return []
        found = []
        for m in re.finditer(self.primary[0], text):
            found.append((m.start(), m[0]))
            if len(found) == MOST:
                break
        return found


def _line_starts(text: str) -> np.ndarray:
    """Where lines begin, after ``\\n`` only, so that a line's number is that of an editor for CRLF texts as well."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(0, np.flatnonzero(codes == 10) + 1)


def _found(text: str | None, rules: Sequence[SourceRule], functions: list[tuple[int, int]]) -> list[tuple]:
    if not text:
        return []
    starts, out = _line_starts(text), []
    for r in rules:
        bounds = list(dict.fromkeys(functions)) if r.within == "function" and functions else [(1, len(starts))]
        n = 0
        for first, last in bounds:
            a = min(max(first - 1, 0), len(starts))
            begin, end = (int(starts[k]) if k < len(starts) else len(text) for k in (a, max(last, first)))
            for at, evidence in r.matches(text[begin:end]):
                if n < MOST:
                    line = int(np.searchsorted(starts, begin + at, "right"))
                    out.append((r.rule_id, first, line, begin + at - int(starts[line - 1]) + 1, begin + at, evidence))
                    n += 1
    return out


def evaluate(texts: DataFrame, rules: Sequence[SourceRule], key: str, text: str, functions: DataFrame | None = None) -> DataFrame:
    """``key``, ``rule_id``, ``segment`` (the line at which the file or function begins), ``line``, ``col`` (both from 1), ``start`` (offset in code points), ``evidence``.

    ``functions``: ``key``, ``line_start``, ``line_end``; a text without any is one segment.  Null and empty texts have no findings.  What a row carries is a text and the bounds of its functions."""
    rules = tuple(rules)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if functions is not None:
        spans = functions.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end"))).alias("spans"))
        rows = rows.join(spans, F.col("key") == F.col("_key"), "left").select("key", "text", "spans")
    kind = rows.schema["key"].dataType.simpleString()
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.string(), *[pa.int32()] * 4, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for k in range(batch.num_rows):
                spans = batch.column(2)[k].as_py() if batch.num_columns > 2 else None
                found = _found(batch.column(1)[k].as_py(), rules, [(s["line_start"], s["line_end"]) for s in spans or []])
                which += [k] * len(found)
                out += found
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["key", *names])

    return rows.mapInArrow(run, f"key {kind}, {FOUND}").withColumnRenamed("key", key)
