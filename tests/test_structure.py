"""Control flow of random nested statements against a twin that walks the trees."""

import random

import pytest

from lodestone.operators.structure import ancestors, control_flow, nested

EXIT = (None, "exit")


def grown(rng: random.Random, depth: int, ids: list[int]) -> list[dict]:
    """Random statements; each has an id, a kind and its clauses, (id, kind, statements)."""
    out = []
    for _ in range(rng.randint(0 if depth else 1, 3)):
        kind = rng.choice(["plain", "if", "loop", "switch", "try", "return", "throw", "break", "continue"] if depth < 4 else ["plain", "return", "break", "continue"])
        names = {
            "if": ["then"] + ["otherwise"] * rng.randint(0, 1), "loop": ["body"], "switch": ["case"] * rng.randint(0, 2) + ["default"] * rng.randint(0, 1),
            "try": ["guarded"] + ["catch"] * rng.randint(0, 2) + ["completed"] * rng.randint(0, 1) + ["finally"] * rng.randint(0, 1),
        }.get(kind, [])
        ids.append(len(ids))
        out.append({"id": ids[-1], "kind": kind, "clauses": []})
        for n in names:
            ids.append(len(ids))
            own = ids[-1]
            out[-1]["clauses"].append((own, n, grown(rng, depth + 1, ids)))
    return out


def laid_out(fn: int, statements: list[dict], at: int, rows: list[tuple]) -> int:
    for s in statements:
        first, at = at, at + 1
        for own, kind, inner in s["clauses"]:
            begin, at = at, at + 1
            at = laid_out(fn, inner, at, rows) + 1
            rows.append((fn, own, kind, begin, at))
        at += 1
        rows.append((fn, s["id"], s["kind"], first, at))
    return at


class Twin:
    """Emits edges from the top down; ``outs`` is a stack of what encloses: ("loop" or "switch", id) and ("finally", id)."""

    def __init__(self):
        self.edges: set[tuple] = set()
        self.resumes: list[tuple] = []  # (finally, next node)

    def leave(self, src, outs, target, label):
        """A way out across the finallies of ``outs``, inside first."""
        hops = [(f, "in") for kind, f in reversed(outs) if kind == "finally"] + [target]
        self.edges.add((*src, *hops[0], label + "-finally" * (len(hops) > 1)))
        self.resumes += [(a[0], b) for a, b in zip(hops, hops[1:])]

    def sequence(self, statements, start, label, outs, seen):
        tail, how = start, label
        for s in statements:
            node = (s["id"], "in")
            seen.append(s["id"])
            if tail:
                self.edges.add((*tail, *node, how))
            tail, how = self.statement(s, node, outs, seen), "next"
        return tail

    def statement(self, s, node, outs, seen):
        kind, out = s["kind"], (s["id"], "out")
        if kind in ("return", "throw"):
            return self.leave(node, outs, EXIT, "terminal")
        if kind in ("break", "continue"):
            wanted = ("loop", "switch") if kind == "break" else ("loop",)
            at = max((k for k, o in enumerate(outs) if o[0] in wanted), default=None)
            if at is None:
                return node
            return self.leave(node, outs[at + 1 :], (outs[at][1], "out" if kind == "break" else "in"), kind)
        if kind == "plain":
            return node
        if kind == "try":
            self.attempt(s, node, out, outs, seen)
            return out
        inside = [*outs, (kind, s["id"])] if kind in ("loop", "switch") else outs
        for k, (own, name, body) in enumerate(s["clauses"]):
            if kind == "switch":
                self.edges.add((*node, own, "in", name))
                tail, goal = self.sequence(body, (own, "in"), "case-body", inside, seen), out
                how = "case-complete"
                if k + 1 < len(s["clauses"]):
                    goal, how = (s["clauses"][k + 1][0], "in"), "fallthrough"
            else:
                tail = self.sequence(body, node, "false" if name == "otherwise" else "true", inside, seen)
                goal, how = (node, "loop-back") if kind == "loop" else (out, "join")
            if tail:
                self.edges.add((*tail, *goal, how))
        names = [c[1] for c in s["clauses"]]
        if kind == "switch" and "default" not in names:
            self.edges.add((*node, *out, "no-match"))
        if kind == "loop" or kind == "if" and "otherwise" not in names:
            self.edges.add((*node, *out, "false"))
        return out

    def attempt(self, s, node, out, outs, seen):
        by = {}
        for own, name, body in s["clauses"]:
            by.setdefault(name, []).append((own, body))
        fin = by["finally"][0] if "finally" in by else None
        inside = [*outs, ("finally", fin[0])] if fin else outs
        after = ((fin[0], "in"), "finally") if fin else (out, "try-complete")
        under: list[int] = []
        tail = self.sequence(by["guarded"][0][1], node, "try", inside, under)
        if "completed" in by:
            own, body = by["completed"][0]
            if tail:
                self.edges.add((*tail, own, "in", "completed"))
            tail = self.sequence(body, (own, "in"), "completed", inside, seen)
        tails = [tail]
        for own, body in by.get("catch", []):
            self.edges.add((*node, own, "in", "exception-dispatch"))
            self.edges |= {(u, "in", own, "in", "exception") for u in under}
            tails.append(self.sequence(body, (own, "in"), "catch", inside, seen))
        if "catch" not in by:
            for u in under:
                self.leave((u, "in"), inside, EXIT, "uncaught")
        seen += under
        self.edges |= {(*t, *after[0], after[1]) for t in tails if t}
        if fin:
            end = self.sequence(fin[1], (fin[0], "in"), "finally-body", outs, seen)
            if end:
                self.edges.add((*end, *out, "finally-complete"))
            self.ends = {**getattr(self, "ends", {}), fin[0]: end}

    def run(self, statements):
        tail = self.sequence(statements, (None, "entry"), "next", [], [])
        if tail:
            self.edges.add((*tail, *EXIT, "next"))
        for f, goal in self.resumes:
            if self.ends[f]:
                self.edges.add((*self.ends[f], *goal, "finally-resume"))
        return self.edges


SCHEMA = "fn long, id long, kind string, first long, last long"


def test_random_trees_equal_a_walk(spark):
    rng, rows, want = random.Random(7), [], set()
    for fn in range(120):
        tree = grown(rng, 0, [])
        laid_out(fn, tree, 0, rows)
        want |= {(fn, *e) for e in Twin().run(tree)}
    rng.shuffle(rows)
    got = [tuple(r) for r in control_flow(spark.createDataFrame(rows, SCHEMA), "fn").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    kinds = {e[-1] for e in want}
    assert {"finally-resume", "break-finally", "continue-finally", "terminal-finally", "uncaught-finally", "uncaught", "fallthrough", "exception", "no-match", "loop-back"} <= kinds


def test_a_return_meets_both_finallies_from_the_inside_out(spark):
    rows = [
        (1, 1, "try", 0, 100), (1, 2, "guarded", 1, 60), (1, 3, "try", 2, 59), (1, 4, "guarded", 3, 10), (1, 5, "return", 4, 5), (1, 6, "finally", 11, 20),
        (1, 7, "plain", 12, 13), (1, 8, "finally", 61, 90), (1, 9, "plain", 62, 63),
    ]
    got = {tuple(r)[1:] for r in control_flow(spark.createDataFrame(rows, SCHEMA), "fn").collect()}
    assert {(5, "in", 6, "in", "terminal-finally"), (7, "in", 8, "in", "finally-resume"), (9, "in", None, "exit", "finally-resume")} <= got
    assert (5, "in", None, "exit", "terminal") not in got


def test_depths_parents_and_ancestors(spark):
    rows = [(1, 1, "loop", 0, 50), (1, 2, "body", 0, 50), (1, 3, "if", 0, 20), (1, 4, "then", 5, 20), (1, 5, "plain", 6, 7), (1, 6, "plain", 20, 30), (2, 7, "plain", 0, 1)]
    tree = nested(spark.createDataFrame(rows, SCHEMA), "fn")
    assert {(r.id, r.depth, r.parent) for r in tree.collect()} == {(1, 1, None), (2, 2, 1), (3, 3, 2), (4, 4, 3), (5, 5, 4), (6, 3, 2), (7, 1, None)}
    assert {(r.up, r.dist) for r in ancestors(tree, "fn").filter("id = 5").collect()} == {(4, 1), (3, 2), (2, 3), (1, 4)}


def test_empty_tables_and_crossing_intervals(spark):
    assert control_flow(spark.createDataFrame([], SCHEMA), "fn").collect() == []
    with pytest.raises(Exception, match="intervals cross"):
        nested(spark.createDataFrame([(1, 1, "if", 0, 10), (1, 2, "then", 5, 15)], SCHEMA), "fn").collect()
