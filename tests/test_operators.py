import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import findings, flow, graph, joins, lifecycle, rules


def test_nearest_and_containing_equal_brute_force(spark):
    rng = random.Random(3)
    points = [(f"f{rng.randrange(3)}", rng.randrange(600), k) for k in range(200)]
    spans = [(f"f{rng.randrange(2)}", s := rng.randrange(600), s + rng.randrange(200), k) for k in range(60)]
    p = spark.createDataFrame(points, "file string, line int, n int")
    s = spark.createDataFrame(spans, "file string, line_start int, line_end int, id int")
    found = {r.n: r.id for r in joins.containing(p, s, "file", "line", ["id"]).collect()}
    near = {r.n: (r.id, r.distance) for r in joins.nearest(p, s.withColumnRenamed("line_start", "at"), "file", "line", "at", "id").collect()}
    for file, line, n in points:
        inside = min(((e - a, i) for f, a, e, i in spans if f == file and a <= line <= e), default=(None, None))
        assert found[n] == inside[1]
        best = min(((abs(a - line), a, i) for f, a, _, i in spans if f == file), default=None)
        assert near[n] == ((best[2], best[0]) if best else (None, None))


def test_tiers_never_fall_through(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "name string, file string")
    local = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3)], "name string, file string, id int")
    every = spark.createDataFrame([("a", 9), ("c", 8)], "name string, id int")
    out = joins.tiered(rows, [("local", local, ["name", "file"]), ("global", every, ["name"])], "id")
    assert sorted((r.name, r.tier, r.id) for r in out.collect()) == [("a", "local", None), ("b", "local", 3), ("c", "global", 8)]


def test_reach_ends_on_cycles_and_flows_prefer_unsanitised(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (2, 5)], "src int, dst int")
    seeds = spark.createDataFrame([(1, 1)], "origin int, node int")
    assert {(r.node, r.dist) for r in graph.reach(edges, seeds).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 2)}
    blocked = spark.createDataFrame([(4,)], "node int")
    flows = {r.node: (r.clean, r.dist) for r in graph.propagate(edges, seeds, blocked, 5).collect()}
    assert flows[4] == (True, 1) and flows[5] == (False, 2)


def test_far_nodes_are_reached_and_long_flows_stay_unsanitised(spark):
    chain = [(k, k + 1) for k in range(1, 9)]
    edges = spark.createDataFrame([*chain, (1, 20), (20, 9), (30, 8), (9, 1)], "src int, dst int")
    seeds = spark.createDataFrame([(1, 1), (30, 30)], "origin int, node int")
    near = {r.node: (r.dist, r.origin) for r in graph.nearest_origin(edges, seeds).collect()}
    assert near == {1: (0, 1), 30: (0, 30), 20: (1, 1), 8: (1, 30), 9: (2, 1), **{k: (k - 1, 1) for k in range(2, 8)}}
    every = {(r.origin, r.node): r.dist for r in graph.reach(edges, seeds).collect()}
    assert near == {n: min((d, o) for (o, m), d in every.items() if m == n) for _, n in every}
    # 9 is reached sanitised in two steps, unsanitised in eight
    flows = {r.node: (r.clean, r.dist) for r in graph.propagate(edges, seeds.limit(1), spark.createDataFrame([(20,)], "node int")).collect()}
    assert flows[9] == (False, 8) and flows[20] == (True, 1)


def test_definitions_reach_beyond_64_steps(spark):
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(70)], "f int, src int, dst int")
    found = flow.reaching_definitions(edges, spark.createDataFrame([(1, "x", 0)], "f int, variable string, at int"), "f")
    assert sorted(r.node for r in found.collect()) == list(range(1, 71))


def test_balanced_paths_end_with_an_empty_stack_and_bounds_raise(spark):
    rows = [(1, 2, "call", 7), (2, 3, "call", 8), (3, 4, "return", 8), (4, 5, "return", 7), (4, 6, "return", 9), (1, 10, "return", 7), (5, 11, "flow", None)]
    edges = spark.createDataFrame(rows, "src int, dst int, kind string, site long")
    seeds = spark.createDataFrame([(1, 1)], "origin int, node int")
    assert {r.node for r in flow.context_balanced(edges, seeds).collect()} == {1, 5, 11}
    with pytest.raises(ValueError, match="deeper"):
        flow.context_balanced(edges, seeds, 1)
    with pytest.raises(ValueError, match="states"):
        flow.context_balanced(edges, seeds, 32, 3)


def test_simple_paths_to_sinks(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)} | {(k, k + 1) for k in range(20, 28)})
    ends = {3, 8, 26}

    def walk(path):
        return ([path] if len(path) > 1 and path[-1] in ends else []) + [q for a, b in pairs if a == path[-1] and b not in path and len(path) <= 6 for q in walk((*path, b))]

    seeds = spark.createDataFrame([(0, 0), (20, 20)], "origin int, node int")
    found = flow.paths_between(spark.createDataFrame(pairs, "src int, dst int"), seeds, spark.createDataFrame([(n,) for n in ends], "node int"), 6)
    assert sorted(tuple(r.path) for r in found.collect()) == sorted(walk((0,)) + walk((20,))) and (20, 21, 22, 23, 24, 25, 26) in walk((20,))


def test_dispatch_climbs_to_the_top_and_asks_every_subtype(spark):
    parents = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (1, 5), (6, 1), (7, 8), (7, 9)], "type int, parent int")
    methods = spark.createDataFrame([(1, "m"), (3, "m"), (8, "n"), (9, "n"), (8, "k")], "type int, name string")
    wanted = spark.createDataFrame([(5, "m"), (2, "m"), (6, "m"), (7, "n"), (7, "k"), (5, "z")], "type int, name string")
    assert {(r.type, r.name): r.owner for r in flow.dispatch_all(wanted, methods, parents).collect()} == {(5, "m"): 3, (2, "m"): 1, (6, "m"): 1, (7, "n"): None, (7, "k"): 8}
    line = spark.createDataFrame([(k, k - 1) for k in range(2, 7)], "type int, parent int")
    targets = flow.dispatch_targets(spark.createDataFrame([(2, "m"), (6, "m")], "type int, name string"), methods, line)
    assert {tuple(r) for r in targets.collect()} == {(2, "m", 1), (2, "m", 3), (6, "m", 3)}


def test_rule_blocks_and_sequences(spark):
    code = ["open", "body", "close", "open", "guard", "close", "open"]
    lines = spark.createDataFrame([(1, k + 1, c) for k, c in enumerate(code)], "doc_id int, line int, code string")
    is_ = lambda w: F.col("code") == w
    assert [tuple(r) for r in rules.blocks_without(lines, "doc_id", "line", is_("open"), is_("close"), is_("guard")).collect()] == [(1, 1, 3)]
    assert [tuple(r) for r in rules.sequences(lines, "doc_id", "line", is_("open"), is_("close"), 2, is_("guard")).collect()] == [(1, 1, 3)]


def test_text_functions(spark):
    row = spark.range(1).select(
        fn.normal_path(F.lit("a//./b")).alias("a"),
        fn.normal_path(F.lit("a/../b")).alias("b"),
        fn.scrub_strings(F.lit('f("ab", x)')).alias("c"),
        fn.redact(F.lit("Bearer abc.def token=xyz1")).alias("d"),
        fn.entropy(F.lit("aabb")).alias("e"),
        fn.canonical_template(F.lit("/a/<int:x>/:y/{z}")).alias("f"),
        fn.evidence_id("ev:", F.lit("a"), F.lit("b")).alias("g"),
        lifecycle.legacy_fingerprint(F.lit("A1"), F.lit("b22")).alias("h"),
    ).first()
    import hashlib

    assert row[:6] == ("a/b", None, 'f("  ", x)', "[REDACTED] [REDACTED]", 1.0, "/a/{}/{}/{}")
    assert row.g == "ev:" + hashlib.sha256(b"a\0b").hexdigest()[:32]
    assert row.h == hashlib.sha256(b"a#:b##").hexdigest()[:16]


def test_ant_patterns():
    import re

    assert re.match(fn.ant_regex("/a/*/c"), "/a/b/c") and not re.match(fn.ant_regex("/a/*/c"), "/a/b/x/c")
    assert re.match(fn.ant_regex("/a/**"), "/a/b/c") and re.match(fn.ant_regex("/?.x"), "/a.x")


def test_claims(spark):
    jobs = spark.createDataFrame([(1, "queued", 1, 0, 0), (2, "queued", 9, 0, 0), (3, "running", 0, 2, 3), (4, "running", 0, 9, 1)], "job_id int, status string, due int, lease_until int, attempts int")
    out = lifecycle.claimable(jobs, F.lit(5)).collect()
    assert sorted((r.job_id, r.next_status, r.next_attempts) for r in out) == [(1, "running", 1), (3, "failed", 3)]


def test_running_sums_over_ranges(spark):
    rows = [("a", i, i % 7 if i % 11 else None) for i in range(50)] + [("a", 20, 5), (None, 1, 2), (None, 40, 3), ("b", 3, None), ("b", 30, 4)]
    frame = spark.createDataFrame(rows, "k string, n int, v int")
    got = sorted(map(repr, (tuple(r) for r in findings.running_sum(frame, ["k"], "n", 8, F.col("v"), "s").collect())))
    below = lambda k, n: [v for j, m, v in rows if j == k and m <= n and v is not None]
    assert got == sorted(repr((k, n, v, sum(below(k, n)) if below(k, n) else None)) for k, n, v in rows)
    assert findings.running_sum(frame.limit(0), ["k"], "n", 8, F.col("v"), "s").count() == 0


def test_numbers_of_null_keys(spark):
    frame = spark.createDataFrame([(None, 1), (None, 9), ("a", 2)], "k string, n int")
    assert sorted(map(repr, (tuple(r) for r in findings.numbered(frame, ["k"], "n", 4, ["n"], "nth").collect()))) == ["('a', 2, 1)", "(None, 1, 1)", "(None, 9, 2)"]


def test_every_row_has_a_place_in_the_final_order(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.choice([0.1, 0.5, None]), rng.randrange(40), k, 0, 0, 0.0) for k in range(120)]
    frame = spark.createDataFrame(rows, "r int, c double, scan_id long, k_line int, k_part int, k_supp int, k_price double")
    order = sorted(rows, key=lambda x: (x[0], x[1] is None, -(x[1] or 0), x[2:]))
    assert sorted((r.place, r.k_line) for r in findings.ordered(frame, ["r"], "c", 8, "place").collect()) == [(i + 1, x[3]) for i, x in enumerate(order)]


def test_flows_without_sinks_are_none(spark):
    from lodestone.operators import graph

    edges, seeds = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1, 1)], "origin long, node long")
    none = spark.createDataFrame([], "node long, category string")
    found = graph.flows(edges, seeds, none, none)
    assert found.columns == ["origin", "node", "category", "sanitized", "dist"] and found.count() == 0


def test_pairs_of_one_key_are_made_by_many_tasks(spark):
    left, right = spark.range(200).select(F.lit("k").alias("key"), F.col("id").alias("a")), spark.range(150).select(F.lit("k").alias("key"), F.col("id").alias("b"))
    pairs = joins.dealt_pairs(left, right, "key")
    rows = pairs.select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(200) for b in range(150)]
    assert len({r.task for r in rows}) > 20


def test_targets_over_trees_and_over_types_with_two_parents(spark):
    rng = random.Random(4)
    for two in (False, True):
        up = [(k, rng.randrange(k)) for k in range(1, 40)] + ([(k, rng.randrange(k)) for k in range(20, 40, 3)] if two else [(50, 51), (51, 50), (52, 51)])
        methods = [(k, rng.choice("mn")) for k in range(0, 40, 3)] + [(52, "m")]
        wanted = [(k, n) for k in [*range(40), 50, 52] for n in "mn" if rng.random() < 0.7]
        frame = lambda rows, names: spark.createDataFrame(sorted(set(rows)), names)
        args = frame(wanted, "type int, name string"), frame(methods, "type int, name string"), frame(up, "type int, parent int")
        owners = lambda pairs: {(r.type, r.name): r.owner for r in flow.dispatch_all(frame(pairs, "type int, name string"), *args[1:]).collect()}  # noqa: B023, E731
        below = {t: {t} for t, _ in wanted}
        for subs in below.values():
            while more := {s for s, p in up if p in subs} - subs:
                subs |= more
        runs = owners([(s, n) for t, n in wanted for s in below[t]])
        expected = {(t, n, runs[s, n]) for t, n in wanted for s in below[t] if runs.get((s, n)) is not None}
        assert {tuple(r) for r in flow.dispatch_targets(*args).collect()} == expected
