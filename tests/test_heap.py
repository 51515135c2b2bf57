"""States of heap cells and points-to sets against loops over the same tables."""

import random

from lodestone.operators import heap, points_to
from lodestone.operators.points_to import Constraints

STATEMENTS = 'stmt long, op string, to string, frm string, field string, value string, object boolean'


def states(rows, edges, max_rounds=64):
    """The same rounds over sets."""
    out = {s: {(to, None, value, obj)} if op == "make" else set() for s, op, to, _, _, value, obj in rows}
    for _ in range(max_rounds):
        new = {}
        for s, op, to, frm, field, value, obj in rows:
            before = set().union(*(out[a] for a, b in edges if b == s), set())
            has = lambda name: {(v, o) for b, f, v, o in before if b == name and f is None}  # noqa: B023, E731
            gone, made = {(to, None)} if op != "store" else set(), set()
            if op == "make":
                made = {(to, None, value, obj)}
            elif op == "copy":
                made = {(to, None, v, o) for v, o in has(frm)}
            elif op == "load":
                held = {v for v, o in has(frm) if o}
                made = {(to, None, v, o) for b, f, v, o in before if f == field and b in held}
            else:
                held = {v for v, o in has(to) if o}
                made = {(h, field, v, o) for h in held for v, o in has(frm)}
                gone = {(h, field) for h in held} if len(held) == 1 else set()
            new[s] = made | {r for r in before if r[:2] not in gone}
        if new == out:
            return new, False
        out = new
    return out, True


def some(rng, n, base):
    rows, names = [], "abc"
    for k in range(n):
        op = rng.choice(["make", "make", "copy", "load", "store", "store"])
        obj = rng.random() < 0.6
        rows.append((base + k, op, rng.choice(names), rng.choice(names), rng.choice("fg"), f"{'obj' if obj else 'val'}{base + k}" if op == "make" else None, obj if op == "make" else None))
    edges = [(base + k, base + k + 1) for k in range(n - 1)] + [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(0, 3))]
    return rows, edges


def found(spark, rows, edges, **bound):
    state, gaps = heap.heap_states(spark.createDataFrame(rows, STATEMENTS), spark.createDataFrame(edges, "src long, dst long"), **bound)
    got = {s: set() for s, *_ in rows}
    for r in state.collect():
        got[r.stmt].add((r.base, r.field, r.value, r.object))
    return got, {r.stmt for r in gaps.collect()}


def test_states_of_random_programs(spark):
    rng = random.Random(2)
    rows, edges = [], []
    for k in range(80):
        while True:
            a, b = some(rng, rng.randint(3, 9), 100 * k)
            if not states(a, b)[1]:
                break
        rows += a
        edges += b
    got, gaps = found(spark, rows, edges)
    assert gaps == set() and got == states(rows, edges)[0]


def test_one_object_is_replaced_several_are_added_to(spark):
    rows = [
        (1, "make", "a", None, None, "o1", True), (2, "make", "v", None, None, "old", False), (3, "store", "a", "v", "f", None, None), (4, "make", "w", None, None, "new", False),
        (5, "store", "a", "w", "f", None, None), (6, "make", "a", None, None, "o2", True), (7, "store", "a", "v", "f", None, None), (8, "store", "a", "w", "f", None, None),
    ]
    # 5 replaces in o1; 8 is met with a = o1 or o2 and adds to both
    got, gaps = found(spark, rows, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (5, 8), (7, 8)])
    fields = lambda s: {r[:3] for r in got[s] if r[1]}
    assert fields(3) == {("o1", "f", "old")} and fields(5) == {("o1", "f", "new")}
    assert fields(7) == {("o1", "f", "new"), ("o2", "f", "old")}
    assert fields(8) == {("o1", "f", "new"), ("o2", "f", "old"), ("o2", "f", "new")} and gaps == set()


def test_a_bound_on_rounds_leaves_open_statements(spark):
    rows = [(k, "make" if k == 0 else "copy", "a", "a", None, "x" if k == 0 else None, False) for k in range(6)]
    got, gaps = found(spark, rows, [(k, k + 1) for k in range(5)], max_rounds=3)
    assert got[3] and not got[5] and gaps


def test_no_statements(spark):
    assert found(spark, [], []) == ({}, set())


SCHEMAS = {
    "entries": "fn long", "allocations": "fn long, name string, obj long, type string", "assigns": "fn long, to string, frm string", "stores": "fn long, base string, field string, frm string",
    "loads": "fn long, to string, base string, field string", "calls": "fn long, site long, callee long, receiver string, method string", "methods": "type string, method string, fn long",
    "arguments": "site long, index int, name string", "parameters": "fn long, index int, name string", "results": "site long, to string", "returns": "fn long, name string",
}


def naive(t, depth):
    """All rules over all facts until nothing is new."""
    at, var, field, call = {(f, ()) for (f,) in t["entries"]}, set(), set(), set()
    kind = {(o, ty) for _, _, o, ty in t["allocations"]}
    size = -1
    cut = lambda ctx, site: (*ctx, site)[-depth:] if depth else ()
    while size != len(at) + len(var) + len(field) + len(call):
        size = len(at) + len(var) + len(field) + len(call)
        for f, c in list(at):
            var |= {(c, f, n, o) for g, n, o, _ in t["allocations"] if g == f}
            call |= {(c, s, e, cut(c, s)) for g, s, e, _, _ in t["calls"] if g == f and e is not None}
        for c, f, n, o in list(var):
            var |= {(c, f, to, o) for g, to, frm in t["assigns"] if (g, frm) == (f, n)}
            for g, s, e, r, m in t["calls"]:
                if e is None and (g, r) == (f, n):
                    for ty, mm, fn in t["methods"]:
                        if mm == m and (o, ty) in kind:
                            call.add((c, s, fn, cut(c, s)))
                            var.add((cut(c, s), fn, "this", o))
            for g, b, fl, frm in t["stores"]:
                if (g, b) == (f, n):
                    field |= {(o, fl, p) for cc, gg, m, p in var if (cc, gg, m) == (c, f, frm)}
            for g, to, b, fl in t["loads"]:
                if (g, b) == (f, n):
                    var |= {(c, f, to, p) for h, k, p in field if (h, k) == (o, fl)}
        for c, s, e, into in list(call):
            at.add((e, into))
            caller = next(g for g, x, *_ in t["calls"] if x == s)
            for x, i, n in t["arguments"]:
                for fn, j, p in t["parameters"]:
                    if x == s and fn == e and i == j:
                        var |= {(into, e, p, o) for cc, g, m, o in var if (cc, g, m) == (c, caller, n)}
            for x, to in t["results"]:
                for fn, n in t["returns"]:
                    if x == s and fn == e:
                        var |= {(c, caller, to, o) for cc, g, m, o in var if (cc, g, m) == (into, e, n)}
    return var, call


def constraints(rng, base):
    t = {n: [] for n in SCHEMAS}
    fns = [base + k for k in range(rng.randint(2, 4))]
    names, types = ["x", "y", "z", "this", "p"], [f"T{base}", f"U{base}"]
    t["entries"] = [(fns[0],)]
    t["methods"] = [(ty, m, rng.choice(fns)) for ty in types for m in "mn" if rng.random() < 0.8]
    for f in fns:
        t["parameters"] += [(f, 0, "p")]
        t["returns"] += [(f, rng.choice(names))] * rng.randint(0, 1)
        t["allocations"] += [(f, rng.choice(names[:3]), base + 10 * (f - base) + k, rng.choice(types)) for k in range(rng.randint(0, 2))]
        t["assigns"] += [(f, rng.choice(names[:3]), rng.choice(names)) for _ in range(rng.randint(0, 2))]
        t["stores"] += [(f, rng.choice(names), rng.choice("fg"), rng.choice(names)) for _ in range(rng.randint(0, 2))]
        t["loads"] += [(f, rng.choice(names[:3]), rng.choice(names), rng.choice("fg")) for _ in range(rng.randint(0, 2))]
        for k in range(rng.randint(1, 3)):
            site = base + 10 * (f - base) + k
            t["calls"].append((f, site, rng.choice(fns), None, None) if rng.random() < 0.5 else (f, site, None, rng.choice(names), rng.choice("mn")))
            t["arguments"].append((site, 0, rng.choice(names)))
            t["results"] += [(site, rng.choice(names[:3]))] * rng.randint(0, 1)
    return t


def solved(spark, t, **bounds):
    c = Constraints(**{n: spark.createDataFrame(t.get(n, []), s) for n, s in SCHEMAS.items()})
    var, call, gaps = points_to.points_to(c, **bounds)
    return {(tuple(r.ctx), r.fn, r.name, r.obj) for r in var.collect()}, {(tuple(r.ctx), r.site, r.fn, tuple(r.to)) for r in call.collect()}, [r.reason for r in gaps.collect()]


def test_points_to_equals_all_rules_over_all_facts(spark):
    rng = random.Random(4)
    t = {n: [] for n in SCHEMAS}
    for k in range(25):
        for n, rows in constraints(rng, 1000 * k).items():
            t[n] += rows
    var, call = naive(t, 1)
    assert solved(spark, t) == (var, call, [])
    assert len(var) > 100 and any(c for c, *_ in var)


def test_points_to_bounds(spark):
    t = {"entries": [(1,)], "calls": [(1, 5, 2, None, None), (2, 6, 3, None, None)], "allocations": [(3, "x", 9, "T")]}
    assert solved(spark, t)[0] == {((6,), 3, "x", 9)}
    assert solved(spark, t, depth=2)[0] == {((5, 6), 3, "x", 9)}
    assert solved(spark, t, max_contexts=1)[2] == ["more than 1 contexts"]
    assert solved(spark, {}) == (set(), set(), [])
