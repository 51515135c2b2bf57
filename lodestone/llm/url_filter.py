"""URL filters: a trie over reversed host labels and path segments.

The rules form one trie.  A host ``a.b.org`` walks the labels ``org``, ``b``, ``a``; each label's node
may hold a second trie over path segments.  A rule's path is a prefix of the url's path; the segments
of a path keep their closing slash, so a path prefix that ends in a slash is a path in the trie, and a
last, open segment is compared as a string prefix.  Among the rules that fit, the one with the longest
host wins, then the one with the longest path; a tie between allow and block goes to block.

The trie is broadcast.  ``max_rules`` bounds it: more rules are an error, not a silent truncation.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no rule
and gets the default verdict, as does any url that fits no rule; a very long url is judged whole, and only as far as the trie is deep are its labels and
segments looked up; repeated rows give repeated results; an empty table gives an empty table.
Columns of the input other than the id and the url are not carried over, so clashing names can't occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import UPPER

MAX_RULES = 1_000_000
_LOWER = str.maketrans(UPPER, UPPER.lower())


@dataclass(slots=True)
class PathNode:
    """``verdict`` ends here; ``open`` holds verdicts of rules whose last segment has no closing slash."""

    verdict: str | None = None
    rule: str | None = None
    children: dict[str, PathNode] = field(default_factory=dict)
    open: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass(slots=True)
class HostNode:
    children: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    return host.translate(_LOWER), rest[: min(ends)] if ends else rest


def segments(path: str) -> tuple[list[str], str]:
    """The segments with their closing slash, and what follows the last slash."""
    parts = path.split("/")
    return [f"{p}/" for p in parts[:-1]], parts[-1]


def build_trie(rules: Iterable[tuple[str, str, str]], max_rules: int = MAX_RULES) -> HostNode:
    """``rules``: (host, path, ``allow`` or ``block``)."""
    root = HostNode()
    for n, (host, path, verdict) in enumerate(rules):
        if n >= max_rules:
            raise ValueError(f"more than {max_rules} rules; the trie is broadcast, so its size is bounded")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict}")
        host = host.translate(_LOWER)
        node = root
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, HostNode())
        node.paths = place = node.paths or PathNode()
        closed, rest = segments(path)
        for segment in closed:
            place = place.children.setdefault(segment, PathNode())
        if rest:
            place.open = [x for x in place.open if (x[0], x[1]) != (rest, "allow")]
            if not any(x[0] == rest for x in place.open):
                place.open.append((rest, verdict, host + path))
                place.open.sort(key=lambda x: -len(x[0]))
        elif place.verdict != "block":
            place.verdict, place.rule = verdict, host + path
    return root


def _longest_path(node: PathNode, path: str) -> tuple[str, str] | None:
    closed, rest = segments(path)
    best = None
    for segment in [*closed, None]:
        if node.verdict:
            best = (node.verdict, node.rule)
        tail = segment if segment is not None else rest
        for prefix, verdict, rule in node.open:
            if tail.startswith(prefix):
                best = (verdict, rule)
                break
        if segment is None or segment not in node.children:
            return best
        node = node.children[segment]
    return best


def judge(trie: HostNode, host: str, path: str) -> tuple[str, str] | None:
    """The verdict and the rule that decides, or None."""
    best, node = None, trie
    if not host:
        return None
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        if node.paths is not None:
            best = _longest_path(node.paths, path) or best
    return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """A row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(build_trie(rules, max_rules))
    kept = pages.select(id_col, url_col)
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                verdict, rule = judge(trie, host, path) or (default, None)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
