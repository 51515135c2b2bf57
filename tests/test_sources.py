import json

from lodestone.sources import artifacts, files, sinks


def _write(tmp_path, name, body):
    (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return str(tmp_path)


def test_sarif_keeps_results_inside_the_repository(spark, tmp_path):
    place = lambda uri, line: [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}]
    rule = {"id": "A", "properties": {"tags": ["external/cwe/cwe-089"], "security-severity": "9.1"}}
    results = [
        {"ruleId": "A", "level": "error", "message": {"text": "m"}, "locations": place("src/./a.py", 3)},
        {"ruleId": "B", "message": {"text": "n"}, "locations": place("../out.py", 1)},
        {"ruleId": "B", "message": {"text": "n"}, "locations": place("b.py", 7)},
        {"ruleId": "B", "message": {"text": "none"}},
    ]
    run = {"tool": {"driver": {"name": "t", "rules": [rule]}}, "results": results}
    root = _write(tmp_path, "a.sarif", {"version": "2.1.0", "runs": [run]})
    _write(tmp_path, "b.sarif", "not json")
    _write(tmp_path, "c.sarif", {"version": "1.0", "runs": [run]})
    docs = artifacts.documents(spark, root)
    rows = sorted(tuple(r)[1:] for r in artifacts.sarif(docs).collect())
    assert rows == [("t", "A", "error", "m", "src/a.py", 3, 3, 89, "critical"), ("t", "B", "warning", "n", "b.py", 7, 7, None, "medium")]
    assert artifacts.problems(docs, "sarif").count() == 1


def test_har_and_otel(spark, tmp_path):
    entry = {"time": 12.5, "request": {"method": "get", "url": "https://h/a//b?x=1#f"}, "response": {"status": 200}}
    root = _write(tmp_path, "x.har", {"log": {"entries": [entry]}})
    assert [tuple(r)[1:] for r in artifacts.har(artifacts.documents(spark, root)).collect()] == [("GET", "/a/b", 200, 12.5)]
    span = lambda i, p, a, b: {"traceId": "t", "spanId": i, "parentSpanId": p, "name": "n", "startTimeUnixNano": a, "endTimeUnixNano": b, "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}
    other = tmp_path / "otel"
    other.mkdir()
    spans = [span("1", "", "1000000", "3500000"), span("2", "1", "5", "1")]
    root = _write(other, "o.json", {"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]})
    rows = artifacts.otel(artifacts.documents(spark, root)).collect()
    assert [(r.span_id, r.parent_span_id, r.duration_ms, r.attributes) for r in rows] == [("1", None, 2.5, {"k": "v"}), ("2", "1", None, {"k": "v"})]


def test_openapi(spark, tmp_path):
    spec = {
        "servers": [{"url": "https://h/v1/"}],
        "security": [{"key": []}],
        "paths": {"/p/{id}": {"get": {"operationId": "g", "parameters": [{"name": "q", "in": "query"}]}, "post": {"security": []}, "summary": "s"}},
    }
    rows = artifacts.openapi(artifacts.documents(spark, _write(tmp_path, "o.json", spec))).collect()
    assert sorted((r.method, r.path, r.operation_id, r.params, r.auth_required) for r in rows) == [
        ("GET", "/v1/p/{id}", "g", ["id", "q"], True),
        ("POST", "/v1/p/{id}", None, ["id"], False),
    ]


def test_case_labels(spark, tmp_path):
    root = _write(tmp_path, "l.csv", "# name\na,sqli,true,89\nb,xss,false,79\n")
    assert sorted(map(tuple, artifacts.case_labels(spark, root).collect())) == [("a", "sqli", True, 89), ("b", "xss", False, 79)]


def test_file_scan_and_python_facts(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nclass C(B):\n    def f(self, x):\n        return os.path.join(x, 'y')\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "n.txt").write_text("x")
    (tmp_path / "s.go").write_text("package main")
    kept, gaps = files.admitted(files.scan(spark, str(tmp_path)), ("python",))
    assert sorted(map(tuple, gaps.collect())) == [("not_configured", 1), ("unsupported", 1)]
    facts = {(r.kind, r.name, r.line_start, tuple(r.parts)) for r in files.python_facts(kept).collect()}
    assert facts == {
        ("import", "os", 1, ("os",)),
        ("class", "C", 2, ("B",)),
        ("function", "f", 3, ("self", "x")),
        ("call", "os.path.join", 4, ("x", "'y'")),
        ("error", "SyntaxError", None, ()),
    }


def test_sarif_round_trip_and_project_replacement(spark, tmp_path):
    rows = spark.createDataFrame([(1, "R1", "high", "m", "a.py", 2, 3), (1, "R2", "low", "n", "b.py", 1, 1)], "scan_id long, rule_id string, severity string, message string, file_path string, line_start int, line_end int")
    docs = sinks.sarif_runs(rows, "lodestone", "scan_id").withColumnRenamed("scan_id", "path")
    back = artifacts.sarif(docs).select("rule_id", "message", "file_path", "line_start", "line_end")
    assert sorted(map(tuple, back.collect())) == [("R1", "m", "a.py", 2, 3), ("R2", "n", "b.py", 1, 1)]
    where = str(tmp_path / "t")
    sinks.replace_projects(spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, v string"), where)
    sinks.replace_projects(spark.createDataFrame([(2, "c")], "project_id int, v string"), where)
    assert sorted((r.project_id, r.v) for r in spark.read.parquet(where).collect()) == [(1, "a"), (2, "c")]
