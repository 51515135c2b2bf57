import json

import pytest

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators.storage import Store
from lodestone.sources import artifacts, endpoints, evidence, files, manifests


def test_escapes_that_cannot_be_decoded_are_null(spark):
    texts = [r"a\n\x41B\u{1F600}\'q", r"\0z", r"\01", r"\u12", "x\\", r"\ud83d", r"\u{110000}", "", None, "a\\\nb", "a\\\r\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.decode_escapes(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == ["a\nAB\U0001f600'q", "\x00z", None, None, None, None, None, "", None, "ab", "ab"]


def test_annotations(spark):
    rows = spark.createDataFrame([('@get:a.b.Name("x", \'y\', "x")',), ("Name",), (None,)], "a string")
    assert [tuple(r) for r in rows.select(fn.annotation_name(F.col("a")), fn.annotation_strings(F.col("a"))).collect()] == [("@Name", ["x", "y"]), ("", []), ("", None)]


def test_registrations_keep_their_lines(spark):
    rows = [
        ("a.ts", "typescript", "\napp.get('/a', h)\n\nrouter.post(\n '/b', h); app.all('/c',h)\n@Get()\n"),
        ("c.rs", "rust", '#[get("/z")]\n.route("/w", post(h))'),
        ("d.py", "python", "app.get('/no', h)\nre_path('x/', views.x)"),
        ("e.py", "python", None),
        ("f", None, "app.get('/a', h)"),
        ("g.go", "go", ""),
    ]
    got = endpoints.from_sources(spark.createDataFrame(rows, "file_path string, language string, text string")).collect()
    assert sorted(map(tuple, got)) == [
        ("a.ts", "Express", "ALL", "/c", 5), ("a.ts", "Express", "GET", "/a", 2), ("a.ts", "Express", "POST", "/b", 4), ("a.ts", "NestJS", "GET", "", 6),
        ("c.rs", "Axum", "POST", "/w", 2), ("c.rs", "Rust attribute", "GET", "/z", 1), ("d.py", "Django", "ALL", "x/", 2),
    ]


def test_decorators_need_their_framework(spark):
    rows = [
        ("h", ['@app.route("/p/<int:id>", methods=["GET", \'post\'])', "@login_required"], None, ["flask"]),
        ("k", ['@r.get("/q/{x}")'], None, ["os"]),
        ("m", ['@GetMapping("/r")'], ["@RestController", '@RequestMapping("/base/")'], []),
        ("n", ["@PostMapping"], [], None),
        ("v", ["@api_view(['GET', 'PUT'])"], None, None),
        ("z", None, None, None),
    ]
    schema = "name string, decorators array<string>, class_decorators array<string>, modules array<string>"
    frame = spark.createDataFrame(rows, schema).withColumns({"file_path": F.lit("f"), "line_start": F.lit(1)})
    got = endpoints.from_decorators(frame).select("handler", "framework", "method", "path", "params", "auth_required").collect()
    assert sorted(map(tuple, got)) == [
        ("h", "Flask", "GET", "/p/<int:id>", ["id"], True), ("h", "Flask", "POST", "/p/<int:id>", ["id"], True), ("m", "Spring", "GET", "/base/r", [], False),
        ("n", "Spring", "POST", "/", [], False), ("v", "Django", "GET", "/v/", [], False), ("v", "Django", "PUT", "/v/", [], False),
    ]


def test_records_of_other_kinds_are_told_from_missing_ones(spark):
    records = [{"id": "1", "path": "/a?x=1", "line": 3, "filePath": "f.ts", "linkConfidence": 0.5}, {"id": 2, "path": "/b"}, {"linkConfidence": 3}, 5, {"client": "ax", "filePath": "g", "line": None}]
    rows = spark.createDataFrame([(json.dumps(records),), ("{",), ("{}",), (None,), (json.dumps([{"id": "r"}] * 300),)], "raw string")
    got = evidence.endpoint_evidence(rows, "raw", "frontend").drop("raw").collect()
    assert [tuple(r) for r in got[:5]] == [
        (0, "1", "/a", "—", "f.ts:3", 0.5, False, True), (1, None, "/b", "—", "Source location not included", None, True, True),
        (2, None, "Recorded link", "—", "Source location not included", None, True, False), (3, None, "Recorded link", "—", "Source location not included", None, True, False),
        (4, None, "ax", "—", "g", None, False, True),
    ]
    assert len(got) == 205
    steps = [{"file": "a", "line": 3, "message": "m"}, {"file": "a", "line": 0, "message": "m"}, {"file": "a", "line": 1.5, "message": "m"}, {"file": 1, "line": 1, "message": "m"}, 7]
    found = evidence.evidence_steps(spark.createDataFrame([(json.dumps(steps),), ("no",), (None,)], "raw string"), "raw").drop("raw").collect()
    assert [tuple(r) for r in found] == [(0, "a", 3, "m")]


def test_gateway_and_runtime_records(spark):
    for kind, record, expected in [
        ("gateway", {"uri": "lb://x?k=1", "file_path": "g.yml", "line": 2}, ("lb://x", "g.yml:2")),
        ("runtime", {"traceId": "t1", "statusCode": 99}, ("Recorded link", "Trace t1")),
    ]:
        row = evidence.endpoint_evidence(spark.createDataFrame([(json.dumps([record]),)], "raw string"), "raw", kind).first()
        assert (row.label, row.location) == expected
        assert row.malformed == (kind == "runtime")


def test_refused_reports(spark):
    result = lambda **k: {"ruleId": "A", "message": {"text": "m"}, **k}
    place = lambda uri, a, b: [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": a, "endLine": b}}}]
    report = lambda *results, **k: json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}, "results": list(results)}], **k})
    bodies = [
        report(), report(result()), report(result(locations=place("a.py", 1, 1))), "no", report(version="2.0"), report(result(ruleId=" A")), report({"ruleId": "A"}),
        report(result(locations=place("a.py", 2, 1))), report(result(locations=place("../a.py", 1, 1))), None,
    ]
    rows = evidence.sarif_problem(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "path string, body string")).orderBy("path").collect()
    shape = "not one run of SARIF 2.1.0"
    assert [r.problem for r in rows] == [None, None, None, shape, shape, "rule or message", "rule or message", "source range", "source path", shape]


def test_snapshot_budget_and_gaps(spark):
    rows = [("r", "a", "a/1", b"x" * 60), ("r", "a", "a/2", b"y" * 30), ("r", "b", "b/1", b"z" * 20), ("r", "b", "b/2", b"w" * 500), ("r", "c", "c/1", b"\xff\xfe"), ("r", "c", "c/2", b"a\x00"), (None, "a", "a/1", b"password=q\n"), ("r", "d", "d", None)]
    kept, gaps = files.snapshot(spark.createDataFrame(rows, "repository_id string, folder string, path string, content binary"), 100, 100)
    assert sorted((r.repository_id, r.path, r.lines[0][:3]) for r in kept.collect()) == [("", "a/1", "[RE"), ("r", "a/1", "xxx"), ("r", "a/2", "yyy")]
    assert sorted(map(tuple, gaps.collect())) == [("r", "binary", 1), ("r", "budget", 1), ("r", "encoding", 1), ("r", "too_large", 1), ("r", "unavailable", 1)]


def test_expression_reads(spark):
    texts = ["a.b(c, d=e.f[g])", 'f"{x}lit"', "k=v, *w", "(", None, "a.b.c", "", "f()(y).z"]
    rows = files.python_reads(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert [r.reads for r in rows] == [["a", "c", "e.f", "g"], ["x"], ["v", "w"], None, None, ["a.b.c"], [], ["y"]]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load("hashes") is None
    frame = lambda *rows: spark.createDataFrame(rows, "project_id string, path string, hash string, at int")
    store.upsert("hashes", frame(("1", "a", "x", 1), ("1", "b", "y", 1), ("02", "a", "z", 1)), ["path"], "at")
    store.upsert("hashes", frame(("1", "a", "new", 2), ("1", "b", "old", 0)), ["path"], "at")
    assert sorted((r.project_id, r.path, r.hash) for r in store.load("hashes").collect()) == [("02", "a", "z"), ("1", "a", "new"), ("1", "b", "y")]
    store.upsert("hashes", frame(("a/b:c", "a", "x", 1)), ["path"], "at")
    assert store.load("hashes", "a/b:c").count() == 1
    store.clear("hashes", "a/b:c")
    assert store.load("hashes", "a/b:c").count() == 0
    store.clear("hashes", "1")
    assert store.load("hashes", "1").count() == 0
    assert store.load("hashes", "02").count() == 1


def test_workspaces_and_models_are_checked(spark):
    good = {"version": 1, "repositories": [{"id": "a", "path": "x/../a"}, {"id": "b", "path": "/b", "depends_on": ["a"]}]}
    assert [(r.id, r.path, r.depends_on) for r in manifests.workspace(spark, json.dumps(good), "/w").collect()] == [("a", "/w/a", []), ("b", "/b", ["a"])]
    repo = {"id": "a", "path": "a"}
    for bad in [
        {"version": 2, "repositories": [repo]}, {"repositories": []}, {"repositories": [repo, repo]}, {"repositories": [{**repo, "depends_on": ["a"]}]},
        {"repositories": [{**repo, "depends_on": ["z"]}]}, {"repositories": [{**repo, "more": 1}]}, {"repositories": [{"id": "-", "path": "a"}]}, {"repositories": [{"id": "a"}]}, [], {},
    ]:
        with pytest.raises(ValueError):
            manifests.workspace(spark, json.dumps(bad), "/w")
    model = {"id": "m", "role": "sink", "languages": ["java"], "callee": "f", "sink_type": "sql"}
    assert manifests.models(spark, json.dumps({"models": [model]})).first().kind == "sql"
    for bad in [[model, model], [{**model, "role": "source"}], [{**model, "role": "x"}], [{**model, "source_type": "y"}], [{"id": "m"}]]:
        with pytest.raises(ValueError):
            manifests.models(spark, json.dumps({"models": bad}))


def test_contracts_that_are_none_give_no_rows(spark):
    bodies = ["no", None, '{"openapi":"4.0.0","paths":{"/a":{"get":{}}}}', '{"swagger":"2.0"}', '{"swagger":"2.0","paths":{"x-a":{"get":{}},"/a":{"get":{},"x":{}}}}',
              '{"swagger":"2.0","paths":{"/r":{"get":{"parameters":[{"$ref":"#/parameters/L"}]}}},"parameters":{"L":{"$ref":"#/parameters/L"}}}']
    rows = artifacts.contract(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "path string, body string")).select("file", "method", "route", "params", "security", "twice")
    assert sorted(map(tuple, rows.collect())) == [("4", "GET", "/a", [], "undeclared", False), ("5", "GET", "/r", [], "undeclared", False)]
