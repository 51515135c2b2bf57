import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import calls, graph, joins, resolution, routes
from lodestone.sources import artifacts, clients, endpoints, rulefiles, sinks

CALLS = "file_path string, language string, line int, callee string, receiver string, arguments array<string>, context string"


def fired(spark, rules, rows):
    frame = spark.createDataFrame(rows, CALLS).withColumn("facts", calls.argument_facts(F.col("arguments")))
    return sorted((r.line, r.rule_id, r.message) for r in calls.evaluate(frame, rules).collect())


def test_settings_of_a_call_rule(spark):
    rules = [
        calls.CallRule("CONCAT", ("python",), callee=r"execute\($", arguments=r"\+", index=0, without="safe", message="{source}|{callee}|{nothing}"),
        calls.CallRule("WHOLE", callee="get", whole=True, missing=("timeout", "verify")),
        calls.CallRule("CONTEXT", callee="run", receiver="sub", context=("def ",), no_context=("check",), message="m"),
        calls.CallRule("OFF", callee=".*", enabled=False),
    ]
    rows = [
        ("a", "python", 1, "execute", "cur", ["q + x"], ""), ("a", "python", 2, "execute", "cur", ["q", "a + b"], ""), ("a", "go", 3, "execute", None, ["q + x"], ""),
        ("a", "python", 4, "execute", "cur", ["safe + x"], ""), ("a", "python", 5, "execute", "cur", [], ""), ("a", "python", 6, "executemany", None, ["a + b"], ""),
        ("a", "go", 7, "get", None, ["u", "timeout=1"], None), ("a", "go", 8, "get", None, ["timeout=1", "verify=0"], None), ("a", "go", 9, "get", "http", [], None),
        ("a", "go", 10, "run", "subprocess", [], "def f(): run()"), ("a", "go", 11, "run", None, [], "def f(): run()"), ("a", "go", 12, "run", "subprocess", [], "def f(): check()"),
    ]
    assert fired(spark, rules, rows) == [(1, "CONCAT", "q + x|cur.execute|{nothing}"), (7, "WHOLE", "get at a:7"), (10, "CONTEXT", "m")]


def test_options_that_may_be_bound_twice_are_unknown(spark):
    given = {
        "set": ["v", "secure=True"], "twice": ["secure=True", "**{'secure': False}"], "spread": ["**opts"], "none": ["v"], "value": ["secure=flag"],
        "object": ["{ secure: true }"], "again": ["{ secure: true, secure: false }"], "after": ["...more", "{ secure: true }"], "nested": ["{ a: { secure: true }, b: 1 }"], "empty": [],
    }
    frame = spark.createDataFrame([(k, v) for k, v in [*given.items(), ("unread", ["x"])]], "name string, arguments array<string>")
    frame = frame.withColumn("facts", F.when(F.col("name") != "unread", calls.argument_facts(F.col("arguments"))))
    state = lambda name, **where: {r.name: r.s for r in frame.select("name", calls.option_state(F.col("facts"), calls.Option("secure", states=calls.STATES, **where)).alias("s")).collect()}[name]
    keyword = {k: state(k, location="keyword") for k in [*given, "unread"]}
    assert keyword == {"set": "true", "twice": "unknown", "spread": "unknown", "none": "missing", "value": "unknown", "object": "missing", "again": "missing", "after": "missing", "nested": "missing", "empty": "missing", "unread": "unknown"}
    first = {k: state(k, location="argument", argument=0) for k in ("object", "again", "after", "empty", "none", "unread")}
    assert first == {"object": "true", "again": "false", "after": "unknown", "empty": "missing", "none": "unknown", "unread": "unknown"}
    assert state("object", location="argument", argument="all") == "true" and state("after", location="argument", argument="all") == "unknown"
    with pytest.raises(ValueError):
        calls.Option("x", "keyword", ("maybe",))
    with pytest.raises(ValueError):
        calls.Option("x", "argument", ("true",))


def test_rule_files():
    good = {"id": "A", "callee": "x", "languages": ["python", "cobol"]}
    files = [
        ("b.json", json.dumps([good, {"id": "B", "callee": "("}, {"id": "C", "odd": 1}, {"id": "D", "languages": ["cobol"]}, {"callee": "x"}])),
        ("c.json", json.dumps({"rules": [{**good, "severity": "high"}, {"id": "E", "enabled": False}, {"id": "F", "severity": "huge"}]})),
        ("d.json", "[1]"), ("e.json", ""),
    ]
    rules, problems = rulefiles.load(files)
    assert [(r.rule_id, r.severity, r.languages) for r in rules] == [("A", "high", ("python",))]
    assert [(p, m.split(":")[0]) for p, m in problems] == [("b.json", "B"), ("b.json", "C"), ("b.json", "?"), ("c.json", "F"), ("d.json", "a rule is a mapping")]
    registry = rulefiles.Registry(rules).with_rule(calls.CallRule("G")).with_rule(calls.CallRule("A", ("go",)))
    assert [r.rule_id for r in registry.of()] == ["A", "G"] and [r.rule_id for r in registry.of("python")] == ["G"] and [r.rule_id for r in registry.without("G").of()] == ["A"]


def test_dictionary_and_missing_checks(spark):
    with pytest.raises(ValueError):
        calls.dictionary(spark, [("python", "origin", "x", "y")])
    rows = [("a", "python", 1, "execute", "db.cursor", ["q"], ""), ("a", "python", 2, "execute", None, ["q"], ""), ("a", "go", 3, "execute", "cursor", [], ""), ("a", "python", 4, "int", None, ["x"], "")]
    got = calls.marked(spark.createDataFrame(rows, CALLS), calls.dictionary(spark)).select("line", "kind", "category").collect()
    assert sorted(map(tuple, got)) == [(1, "sink", "sql"), (4, "sanitizer", "*")]
    functions = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "fn_id int, is_entry boolean")
    marks = spark.createDataFrame([(1, "use"), (2, "use"), (2, "check"), (3, "use"), (4, "use"), (5, "auth"), (6, "auth")], "fn_id int, mark string")
    edges = spark.createDataFrame([(6, 3), (1, 3)], "src int, dst int")
    assert sorted((r.fn_id, round(r.confidence, 6)) for r in calls.unguarded(functions, marks, edges).collect()) == [(1, 0.8), (3, 0.48)]


def test_annotations_name_their_arguments(spark):
    rows = [("a", ['@PostMapping(produces = "text/plain", value = "/x")'], ['@RequestMapping(path = {"/api"})']), ("b", ["@RequestMapping(method = RequestMethod.PUT)"], None), ("c", ["@org.x.GetMapping"], ["@Secured"])]
    frame = spark.createDataFrame(rows, "name string, decorators array<string>, class_decorators array<string>").withColumns({"modules": F.array(F.lit("x")), "file_path": F.lit("f"), "line_start": F.lit(1)})
    got = endpoints.from_decorators(frame).select("handler", "method", "path", "auth_required").collect()
    assert sorted(map(tuple, got)) == [("a", "POST", "/api/x", False), ("b", "PUT", "", False), ("c", "GET", "/", True)]


def test_routes_in_code_and_their_filters(spark):
    body = """x.route("one", r -> r.path("/a/**").filters(f -> f.stripPrefix(1).rewritePath("/(?<k>x.*)", "/y/${k}")).uri("lb://s"))
      .route("two", r -> r.uri("lb://t")).route('three', r -> r.path("/b/{id}").and().path('/c').uri("u"))"""
    got = clients.coded_routes(spark.createDataFrame([("f", "java", body), ("g", "python", body), ("h", "java", None)], "file_path string, language string, text string"))
    assert [(r.route_id, r.patterns, [(f.name, f.args) for f in r.filters]) for r in got.orderBy("route_id").collect()] == [
        ("one", ["/a/**"], [("stripPrefix", ["1"]), ("rewritePath", ["/(?<k>x.*)", "/y/${k}"])]), ("three", ["/b/{id}", "/c"], []),
    ]
    ways = got.withColumn("methods", F.array().cast("array<string>"))
    asked = spark.createDataFrame([(1, "GET", "https://h/a/xyz?q"), (2, "GET", "/b/7/"), (3, "GET", "/b/7/8"), (4, "PUT", "/c")], "call_id int, method string, client_path string")
    assert sorted((r.call_id, r.client_path) for r in routes.through_routes(asked, ways).collect()) == [(1, "/y/xyz"), (2, "/b/7/"), (4, "/c")]
    ends = spark.createDataFrame([("r", "GET", "/y/{z}"), ("r", "ALL", "/c")], "repository_id string, method string, path string")
    assert sorted((r.path, r.observations) for r in routes.observed(asked, ends, ways).collect()) == [("/c", 1), ("/y/{z}", 1)]


def test_greatest_matching_against_all_choices(spark):
    import itertools
    import random

    def most(given, wanted):
        if not given:
            return 0
        rest = most(given[1:], wanted)
        return max([rest, *(1 + most(given[1:], wanted[:k] + wanted[k + 1 :]) for k, w in enumerate(wanted) if abs(w - given[0]) <= 2)])

    rng = random.Random(4)
    cases = {k: ([rng.randrange(14) for _ in range(rng.randrange(6))], [rng.randrange(14) for _ in range(rng.randrange(6))]) for k in range(60)}
    frame = lambda side: spark.createDataFrame([(k, x) for k, both in cases.items() for x in both[side]] + [(0, None)], "k int, at int")
    got = joins.matched_lines(frame(0), frame(1), ["k"], "at", 2).groupBy("k").agg(F.sum("actual_matched").alias("a"), F.sum("expected_matched").alias("e")).collect()
    assert {r.k: (r.a, r.e) for r in got} == {k: (most(a, b),) * 2 for k, (a, b) in cases.items() if a or b}
    assert list(itertools.islice(cases, 1)) == [0]


def test_overload_scores(spark):
    one = lambda given, params, optional=(), variadic=False: spark.range(1).select(
        resolution.overload_score(F.transform(F.array(*map(F.lit, given)).cast("array<string>"), resolution.bare_type), F.transform(F.array(*map(F.lit, params)).cast("array<string>"), resolution.bare_type), F.array(*map(F.lit, optional)).cast("array<boolean>"), F.lit(variadic))
    ).first()[0]
    assert one(["int"], ["long"]) == 5 and one(["Integer"], ["int"]) == 8 and one(["long"], ["int"]) is None and one([""], ["X"]) == 4
    assert one([], []) == 4 and one([], ["int"]) is None and one([], ["int"], [True]) == 2 and one(["int", "int"], ["int"]) is None
    assert one(["a.b.String", "String", "java.lang.String"], ["@N(1) String..."], variadic=True) == 14 and one([], ["X"], variadic=True) == 2 and one(["null"], ["int"]) is None and one(["null"], ["List<X>"]) == 5


def test_components_gaps_and_categories(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), (7, None), (3, 11), (11, 12)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 11: 1, 12: 1, 4: 4, 5: 4, 9: 9}
    seeds = spark.createDataFrame([(1, 1)], "origin int, node int")
    found, gap = graph.reach_within(edges, seeds, 2)
    assert sorted(r.node for r in found.collect()) == [1, 2, 3] and [tuple(r) for r in gap.collect()] == [(1, 3)]
    assert graph.reach_within(edges, seeds, 4)[1].count() == 0
    sinks_ = spark.createDataFrame([(12, "sql"), (12, "path"), (3, "sql")], "node int, category string")
    stops = spark.createDataFrame([(11, "sql")], "node int, category string")
    got = graph.flows(edges, seeds, sinks_, stops).collect()
    assert sorted((r.node, r.category, r.sanitized, r.dist) for r in got) == [(3, "sql", False, 2), (12, "path", False, 4), (12, "sql", True, 4)]


def test_readers_of_other_scanners(spark, tmp_path):
    report = {"results": [{"check_id": "r", "path": "a.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "m", "severity": "ERROR"}}, {"check_id": "s", "path": "b"}]}
    rows = artifacts.semgrep(spark.createDataFrame([("f", json.dumps(report)), ("g", "{}"), ("h", "no")], "path string, body string")).collect()
    assert [(r.rule_id, r.file_path, r.line_start, r.line_end, r.severity) for r in rows] == [("r", "a.py", 2, 3, "error"), ("s", "b", None, None, None)]
    records = [
        {"kind": "node", "id": "1", "label": "METHOD", "outE": {"CFG": [{"id": "e", "inV": "2"}, {"id": "f"}], "AST": [{"inV": "3"}]}}, {"kind": "node", "id": "2", "label": "CALL"},
        {"kind": "edge", "source": "2", "target": "1", "label": "REF"}, {"kind": "finding", "rule": "R", "id": "2", "line": 7}, {"kind": "other"},
    ]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, records)))
    nodes, edges, found = artifacts.joern(spark, str(tmp_path / "j.jsonl"))
    assert sorted(map(tuple, nodes.collect())) == [("1", "METHOD"), ("2", "CALL")]
    assert sorted(map(tuple, edges.collect())) == [("1", "2", "CFG"), ("1", "3", "AST"), ("2", "1", "REF")]
    assert [tuple(r) for r in found.collect()] == [("R", "2", 7)]


def test_reports_for_people(spark):
    rows = [("s", "R|1", "low", "a\nb", "x.py", 3, 4, "advisory", 0.5, [("x.py", 1, "in"), ("y.py", 2, "out")]), ("s", "R2", "critical", "50%", "y,z.py", 1, 1, "blocking", 0.9, None)]
    schema = "scan string, rule_id string, severity string, message string, file_path string, line_start int, line_end int, disposition string, confidence double, steps array<struct<file:string,line:int,message:string>>"
    frame = spark.createDataFrame(rows, schema)
    assert sinks.markdown_table(frame).split("\n")[2:] == ["| critical | R2 | y,z.py:1 | 50% |", "| low | R\\|1 | x.py:3 | a b |"]
    assert sorted(r.line for r in sinks.annotations(frame).collect()) == ["::error file=y%2Cz.py,line=1,title=R2::50%25", "::warning file=x.py,line=3,title=R|1::a%0Ab"]
    run = json.loads(sinks.sarif_runs(frame, "t", "scan").first().body)["runs"][0]
    places = [[x["location"]["physicalLocation"]["artifactLocation"]["uri"] for x in r["codeFlows"][0]["threadFlows"][0]["locations"]] for r in run["results"] if "codeFlows" in r]
    assert places == [["x.py", "y.py"]] and len(run["results"]) == 2
