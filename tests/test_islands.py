"""Searches of islands in a task each, and of larger ones by joins, against a search one origin at a time."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from lodestone.operators import graph, islands


def world(rng, n_islands, n, degree):
    """Edges between nodes of one island each; the last node of an island has none."""
    return sorted({(b + rng.randrange(n - 1), b + rng.randrange(n - 1)) for b in range(0, n_islands * n, n) for _ in range(degree * n)})


def walk(edges, start, stop=frozenset(), depth=None):
    """``{(node, clean): (dist, least predecessor)}``; the predecessor counts flows that have met nothing only."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    seen, front, step = {(x, False): (0, None) for x in start}, {(x, False) for x in start}, 0
    while front and (depth is None or step < depth):
        step, new = step + 1, {}
        for a, clean in sorted(front):
            for b in out[a]:
                key = (b, clean or b in stop)
                if key not in seen:
                    new.setdefault(key, (step, a))
        front = set(new)
        seen.update(new)
    return seen


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    edges = world(rng, 4, 60, 3)
    seeds = [(o, 60 * rng.randrange(4) + rng.randrange(60)) for o in range(80) for _ in range(1 + o % 2)]
    return edges, seeds, spark.createDataFrame(edges, "src long, dst long").repartition(3), spark.createDataFrame(seeds, "origin long, node long")


def starts(seeds):
    of = defaultdict(list)
    for o, x in seeds:
        of[o].append(x)
    return of


#: All in one group; islands within and beyond the bound; all by joins.
@pytest.mark.parametrize(("most", "depth"), [(islands.LINKS, None), (172, None), (10, 2)])
def test_reach_and_parents(spark, tables, most, depth):
    edges, seeds, e, s = tables
    expected = {(o, x): d for o, at in starts(seeds).items() for (x, _), d in walk(edges, at, depth=depth).items()}
    rows = graph.shortest_tree(e, s, depth, most).collect()
    assert {(r.origin, r.node): (r.dist, r.parent) for r in rows} == expected and len(rows) == len(expected)
    assert sorted((r.origin, r.node, r.dist) for r in graph.reach(e, s, depth, most=most).collect()) == sorted((*k, d) for k, (d, _) in expected.items())
    wanted = spark.createDataFrame([(x,) for x in range(0, 240, 7)], "node long")
    assert sorted((r.origin, r.node, r.dist) for r in graph.reach(e, s, depth, wanted, most).collect()) == sorted((*k, d) for k, (d, _) in expected.items() if k[1] % 7 == 0)


@pytest.mark.parametrize("most", [islands.LINKS, 172])
def test_flows_and_facts(spark, tables, most):
    edges, seeds, e, s = tables
    stop = {"a": set(range(0, 240, 3)), "b": set(range(0, 240, 5))}

    def best(at, stops, depth=None):
        found = {}
        for (x, clean), (dist, _) in walk(edges, at, stops, depth).items():
            found[x] = min(found.get(x, (clean, dist)), (clean, dist))
        return found

    blocked = spark.createDataFrame([(x,) for x in stop["a"]], "node long")
    for depth in (None, 3) if most == islands.LINKS else (3,):
        got = sorted((r.origin, r.node, r.clean, r.dist) for r in graph.propagate(e, s, blocked, depth, most).collect())
        assert got == sorted((o, x, c, d) for o, at in starts(seeds).items() for x, (c, d) in best(at, stop["a"], depth).items())
    sinks = {(x, "ab"[x % 2]) for x in range(0, 240, 2)} | {(x, "b") for x in range(0, 240, 4)}
    guards = [(x, "b") for x in stop["b"]] + [(x, "*") for x in stop["a"]] + [(1, "other")]
    found = graph.flows(e, s, spark.createDataFrame(list(sinks), "node long, category string"), spark.createDataFrame(guards, "node long, category string"), most)
    expected = [(o, x, k, c, d) for k in "ab" for o, at in starts(seeds).items() for x, (c, d) in best(at, stop["a"] | (stop["b"] if k == "b" else set())).items() if (x, k) in sinks]
    assert sorted(tuple(r[c] for c in ("origin", "node", "category", "sanitized", "dist")) for r in found.collect()) == sorted(expected)


def test_texts_long_chains_and_many_words(spark):
    chain = [(f"n{k:05}", f"n{k + 1:05}") for k in range(700)] + [(f"m{k}", f"m{k + 1}") for k in range(4800)]
    e = spark.createDataFrame(chain, "src string, dst string")
    s = spark.createDataFrame([(f"o{k}", f"n{k:05}") for k in range(600)] + [("alone", "nowhere"), (None, "n00001")], "origin string, node string")
    rows = graph.reach(e, s).collect()
    assert len(rows) == sum(701 - k for k in range(600)) + 1
    assert all(r.dist == (0 if r.origin == "alone" else int(r.node[1:]) - int(r.origin[1:])) for r in rows)


def test_values_that_a_task_does_not_tell_apart_are_left_to_joins(spark):
    schema = T.StructType([T.StructField("src", T.ArrayType(T.IntegerType())), T.StructField("dst", T.ArrayType(T.IntegerType()))])
    assert not islands.fits(spark.createDataFrame([([1], [2])], schema))


def test_near_origins_share_a_word(spark):
    """Origins of one island are written as bits of few words, not spread over all of them."""
    numbers = graph._numbered(spark.range(6400).toDF("origin")).collect()
    words = defaultdict(list)
    for r in numbers:
        words[tuple(r.word)].append(r.origin)
    assert all(max(w) - min(w) < 128 and len(w) <= 64 for w in words.values())
