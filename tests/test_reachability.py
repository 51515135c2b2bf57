"""The reachability index against closures of random graphs."""

import random

from lodestone.operators import reachability


def closure(edges):
    nodes = {x for e in edges for x in e}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[n] = seen
    return out


def graph(rng, base, n, m, back):
    """Mostly forward edges, some back."""
    out = set()
    for _ in range(m):
        a, b = sorted(rng.sample(range(n), 2))
        out.add((base + b, base + a) if rng.random() < back else (base + a, base + b))
    return out


def test_index_on_random_graphs(spark):
    rng = random.Random(8)
    edges = graph(rng, 0, 25, 30, 0) | graph(rng, 100, 30, 45, 0.1) | graph(rng, 200, 15, 40, 0.5) | {(300, 300), (301, 302), (302, 301)}
    reach = closure(edges)
    e = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    found = reachability.index(e)
    parts = {r.node: r.component for r in found.components.collect()}
    assert parts == {n: max(x for x in reach[n] if n in reach[x]) for n in reach}
    nodes = sorted(reach)
    pairs = [(a, b) for a in nodes for b in nodes if a // 100 == b // 100] + [(1, 101), (999, 999), (999, 1), (1, 999), (None, 1)]
    got = reachability.can_reach(spark.createDataFrame(pairs, "src long, dst long"), found).collect()
    assert {(r.src, r.dst): r.reaches for r in got} == {(a, b): b in reach.get(a, {a}) for a, b in pairs if a is not None}
    how = {r.decided for r in got}
    assert how == {"same", "component", "range", "label", "search", "unknown"}
    assert sum(r.decided == "search" for r in got) < len(got) / 4


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    found = reachability.index(none)
    got = reachability.can_reach(spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long"), found).collect()
    assert {(r.src, r.dst, r.reaches) for r in got} == {(1, 2, False), (3, 3, True)}
