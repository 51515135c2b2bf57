"""What defends a flow, case by case."""

from lodestone.operators import defence

FLOWS = "file_path string, source_fn long, source_line int, sink_fn long, sink_line int, sink_type string, sanitized boolean"
CALLS = "fn long, file_path string, line int, text string, arguments array<string>"


def test_defences(spark):
    functions = spark.createDataFrame([(1, ["@app.get", "@login_required"]), (2, []), (3, []), (4, ["@login_required"]), (5, []), (6, []), (7, [])], "fn long, decorators array<string>")
    calls = spark.createDataFrame([
        (5, "a", 3, "login_required", []), (2, "a", 5, "db.PREPARE", ["x"]), (2, "a", 9, "db.run", ["v"]), (3, "a", 20, "db.run", ["id = ?"]), (3, "a", 15, "html.Escape", None),
        (3, "a", 16, "escape2", []), (3, "b", 14, "escape", []), (7, "a", 1, "login_required", []),
    ], CALLS)
    #   4 and 5 lead to 2; 5 is nearer to 3; 6 has nobody; 7 asks itself only
    edges = spark.createDataFrame([(4, 2), (5, 2), (2, 3), (5, 3)], "src long, dst long")
    flows = spark.createDataFrame([
        ("a", 1, 1, 1, 2, "path", False), ("a", 2, 1, 2, 9, "sql_query", False), ("a", 3, 14, 3, 20, "sql_query", False), ("a", 3, 16, 3, 20, "path", False), ("a", 6, 1, 6, 2, "path", False),
        ("a", 7, 1, 7, 2, "path", False), ("a", 1, 1, 1, 3, "sql_query", True),
    ], FLOWS)
    found = {(r.sink_fn, r.sink_line, r.sink_type): (r.auth, r.auth_by, r.auth_fn, r.query, r.checked_by) for r in defence.defences(flows, functions, calls, edges, ("@login_required",), ("ESCAPE",)).collect()}
    assert found == {
        (1, 2, "path"): ("decorator", "@login_required", 1, None, None),
        (2, 9, "sql_query"): ("call_chain", "@login_required", 4, "prepared_statement", None),
        (3, 20, "sql_query"): ("function_call", "login_required", 5, "parameterized", "html.Escape"),
        (3, 20, "path"): ("function_call", "login_required", 5, None, "escape2"),
        (6, 2, "path"): (None, None, None, None, None),
        (7, 2, "path"): (None, None, None, None, None),
        (1, 3, "sql_query"): (None, None, None, None, None),
    }
