"""Dominators, frontiers and phi nodes by their definitions on random flow graphs."""

import random

from lodestone.operators import ssa


def reach(edges, entry, without=None):
    seen, todo = set(), [entry] if entry != without else []
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x and b != without]
    return seen


def by_definition(edges, entry, definitions):
    nodes = {x for e in edges for x in e} | {entry}
    alive = reach(edges, entry)
    dom = {n: {d for d in nodes if n not in reach(edges, entry, d)} for n in alive}
    ends = {d: {b for a, b in edges if a in alive and d in dom[a] and not (d in dom[b] and d != b)} for d in alive}
    phis = set()
    for v in {v for v, _ in definitions}:
        todo = [n for w, n in definitions if w == v and n in alive]
        while todo:
            for n in ends[todo.pop()]:
                if (v, n) not in phis:
                    phis.add((v, n))
                    todo.append(n)
    parent = {n: max(dom[n] - {n}, key=lambda d: len(dom[d])) for n in alive if len(dom[n]) > 1}
    return dom, ends, phis, parent


def test_random_flow_graphs(spark):
    rng = random.Random(9)
    edges, entries, definitions, want = [], [], [], ({}, {}, set(), {})
    for f in range(40):
        n = rng.randint(2, 9)
        own = {(k, k + 1) for k in range(n - 1) if rng.random() < 0.8} | {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 6))}
        defs = [(v, rng.randrange(n)) for v in "xy" for _ in range(rng.randint(0, 3))]
        edges += [(f, a, b) for a, b in own]
        entries.append((f, 0))
        definitions += [(f, v, x) for v, x in defs]
        dom, ends, phis, parent = by_definition(own, 0, defs)
        want[0].update({(f, k): v for k, v in dom.items()})
        want[1].update({(f, k): v for k, v in ends.items() if v})
        want[2].update((f, v, x) for v, x in phis)
        want[3].update({(f, k): v for k, v in parent.items()})
    e = spark.createDataFrame([*edges, (0, None, 1)], "fn long, src long, dst long")
    first, defs = spark.createDataFrame(entries, "fn long, node long"), spark.createDataFrame(definitions, "fn long, variable string, at long")
    dominated = ssa.dominators(e, first, "fn")
    got = {}
    for r in dominated.collect():
        got.setdefault((r.fn, r.node), set()).add(r.dominator)
    assert got == want[0]
    ends = {}
    for r in ssa.frontiers(e, dominated, "fn").collect():
        ends.setdefault((r.fn, r.node), set()).add(r.frontier)
    assert ends == want[1]
    assert {(r.fn, r.node): r.parent for r in ssa.immediate(dominated, "fn").collect()} == want[3]
    assert {(r.fn, r.variable, r.node) for r in ssa.phi_nodes(e, first, defs, "fn").collect()} == want[2]
    assert want[2] and ssa.phi_nodes(e.limit(0), first.limit(0), defs, "fn").count() == 0
