"""Paths against enumeration, caps against the loop."""

import random
from collections import deque

from lodestone.operators import caps, paths


def levels(edges, start):
    dist, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in sorted(edges):
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                todo.append(b)
    return dist


def all_shortest(edges, source, sink):
    dist = levels(edges, source)
    if sink not in dist:
        return []
    found = [[source]]
    for k in range(dist[sink]):
        found = [[*p, b] for p in found for a, b in sorted(edges) if a == p[-1] and dist[b] == k + 1]
    return sorted(p for p in found if p[-1] == sink)


def test_first_shortest_paths(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)}
    sources, sinks = rng.sample(range(30), 6), rng.sample(range(30), 6)
    every = [(s, z, p) for s in sorted(sources) for z in sorted(sinks) for p in all_shortest(edges, s, z)]
    e = spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long")
    a, b = (spark.createDataFrame([(x,) for x in [*ids, ids[0], None]], "node long") for ids in (sources, sinks))
    for most in (7, 1000):
        found = sorted((r.origin, r.sink, r.path) for r in paths.shortest_paths(e, a, b, most).collect())
        assert found == every[:most]
    assert paths.shortest_paths(e, a.limit(0), b).count() == 0


def test_entry_paths_and_roots(spark):
    #   1 -> 2 -> 3 -> 4, 5 -> 3; 6 -> 7 has a root only, 8 <-> 9 neither; 1 and 10 are entries
    edges = [(1, 2), (2, 3), (3, 4), (5, 3), (6, 7), (8, 9), (9, 8), (10, 2), (10, 4), (11, 7)]
    e = spark.createDataFrame(edges, "src long, dst long")
    rows = lambda *ids: spark.createDataFrame([(x,) for x in ids], "node long")
    found = {r.node: (r.kind, r.path) for r in paths.entry_paths(e, rows(1, 10), rows(3, 4, 7, 8, 1, 6, 99)).collect()}
    assert found == {3: ("entry", [1, 2, 3]), 4: ("entry", [10, 4]), 7: ("root", [6, 7]), 1: ("entry", [1])}


def loop(patterns, matches):
    """What the patterns of each rule and file find, one after the other."""
    kept, gaps = [], []
    for key in sorted({p[:2] for p in patterns}):
        cap, found, all_of, not_run = 5, [], 0, 0
        own = sorted(p[2:] for p in patterns if p[:2] == key)
        for k, (pattern, source) in enumerate(own):
            hits = sorted(m for m in matches if m[:3] == (*key, pattern))
            all_of += len(hits)
            found += hits[:2] if source else hits
            cap = min(cap, 2) if source else cap
            if len(found) >= cap:
                not_run = len(own) - k - 1
                break
        kept += found[:cap]
        if all_of > len(found[:cap]) or not_run:
            gaps.append((*key, cap, all_of - len(found[:cap]), not_run))
    return sorted(kept), sorted(gaps)


def test_caps_equal_the_loop(spark):
    rng = random.Random(7)
    patterns, matches = [], []
    for rule in range(40):
        for file in "ab":
            for p in range(rng.randint(1, 6)):
                patterns.append((f"r{rule}", file, p, rng.random() < 0.3))
                matches += [(f"r{rule}", file, p, rng.randrange(1000)) for _ in range(rng.choice([0, 0, 1, 2, 3, 7]))]
    kept, gaps = caps.folded(spark.createDataFrame(patterns, "rule_id string, file_path string, pattern long, source boolean"), spark.createDataFrame(matches, "rule_id string, file_path string, pattern long, line long"), ["line"])
    assert (sorted(map(tuple, kept.collect())), sorted(map(tuple, gaps.collect()))) == loop(patterns, matches)
