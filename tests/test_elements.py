"""Arrays of big JSON files read in pieces, against a reader of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import artifacts, elements


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def report(rng, n, runs=2):
    nasty = ['plain', 'brace { in [ text', 'quote \\" " and }', '"results":[{', 'line\nend\\', 'é€😀', '']
    made = []
    for k in range(runs):
        rules = [{"id": f"R{i}", "properties": {"tags": ["external/cwe/cwe-0%d" % (20 + i)], "security-severity": str(i + k)}} for i in range(9)]
        results = [
            {"ruleId": f"R{rng.randrange(10)}", "message": {"text": rng.choice(nasty)}, "properties": {"results": [{"a": [1, {"b": "{"}]}, {}]},
             "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"src/{i}.py"}, "region": {"startLine": i % 50}}}]} | ({"level": rng.choice(["error", "note"])} if i % 3 else {})
            for i in range(n)
        ]
        made.append({"tool": {"driver": {"name": "t{", "rules": rules}}, "artifacts": [{"location": {"uri": "x"}}, {}], "results": results, "invocations": [{"ok": True}]})
    return {"version": "2.1.0", "$schema": "s", "runs": made}


COLUMNS = ["rule_id", "level", "message", "file_path", "line_start", "line_end", "cwe", "severity"]


@pytest.mark.parametrize("indent,size", [(None, 700), (1, 5000), (None, 1 << 27)])
def test_reports_equal_the_whole_reader(spark, tmp_path, small_splits, indent, size):
    rng = random.Random(2)
    for k in range(2):
        (tmp_path / f"r{k}.sarif").write_text(json.dumps(report(rng, 40 * k + 7), indent=indent, ensure_ascii=False))
    whole = artifacts.sarif(artifacts.documents(spark, str(tmp_path))).select(*COLUMNS)
    want = sorted(map(str, whole.collect()))
    small_splits(size)
    found = elements.sarif_results(spark, str(tmp_path))
    assert sorted(map(str, found.select(*COLUMNS).collect())) == want and len(want) > 80
    every = elements.elements(spark, str(tmp_path), "results", 4, 2)
    got = sorted((r.file, r.ordinal, r.grp) for r in every.collect())
    assert [o for _, o, _ in got] == [*range(1, 15), *range(1, 95)] and {g for _, _, g in got} == {1, 2}


def test_requests_and_spans(spark, tmp_path, small_splits):
    (tmp_path / "har").mkdir()
    (tmp_path / "otel").mkdir()
    entries = [{"request": {"method": "get", "url": f"http://h/{{{k}}}"}, "response": {"status": k}, "time": 1.5} for k in range(50)]
    (tmp_path / "har" / "a.har").write_text(json.dumps({"log": {"pages": [{"id": "p"}], "entries": entries}}))
    spans = [[{"spanId": f"{a}-{b}", "attributes": [{"key": "k", "value": {"stringValue": "{"}}]} for b in range(20)] for a in range(4)]
    (tmp_path / "otel" / "o.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "x"}]}, "scopeSpans": [{"scope": {}, "spans": s} for s in spans]}]}))
    small_splits(400)
    har = elements.elements(spark, str(tmp_path / "har"), "entries", 3, 1)
    status = har.select("ordinal", F.get_json_object("body", "$.response.status").cast("int").alias("s"), F.get_json_object("body", "$.request.url").alias("u"))
    assert sorted(map(tuple, status.collect())) == [(k + 1, k, f"http://h/{{{k}}}") for k in range(50)]
    otel = elements.elements(spark, str(tmp_path / "otel"), "spans", 6, 4).select("grp", F.get_json_object("body", "$.spanId").alias("s"))
    assert sorted(map(tuple, otel.collect())) == sorted((a + 1, f"{a}-{b}") for a in range(4) for b in range(20))


def test_a_cap_leaves_a_gap_and_other_files_give_nothing(spark, tmp_path):
    (tmp_path / "a.sarif").write_text(json.dumps(report(random.Random(1), 30, runs=1)))
    (tmp_path / "b.txt").write_text("no json } at all {")
    (tmp_path / "c.sarif").write_text("")
    kept, gaps = elements.capped(elements.elements(spark, str(tmp_path), "results", 4, 2), 20)
    assert kept.count() == 20 and [(r.file[-7:], r.kept, r.left_out) for r in gaps.collect()] == [("a.sarif", 20, 10)]


def test_a_big_report_is_read_by_several_tasks(spark, tmp_path, small_splits):
    part = json.dumps(report(random.Random(4), 2000, runs=1))
    head, tail = part.split('"results": [', 1)
    body, end = tail.rsplit('], "invocations"', 1)
    (tmp_path / "big.sarif").write_text(head + '"results": [' + ", ".join([body] * 100) + '], "invocations"' + end)
    small_splits(4 << 20)
    rows = elements._pieces(spark, str(tmp_path))
    assert rows.select("block").distinct().count() > 8
    assert rows.agg(F.max(F.length("piece"))).first()[0] < 1000
    found = elements.elements(spark, str(tmp_path), "results", 4, 2)
    assert found.agg(F.count(F.lit(1)), F.max("ordinal"), F.count_if(F.get_json_object("body", "$.ruleId").isNull())).first()[0:3] == (200_000, 200_000, 0)
