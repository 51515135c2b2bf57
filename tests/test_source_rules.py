"""Offsets, lines and columns of rules over whole texts."""

import random
import time

from lodestone.operators import source_rules
from lodestone.operators.source_rules import SourceRule

TEXTS = "doc_id long, text string, rule_id string"


def found(spark, texts, rules, functions=None):
    rows = spark.createDataFrame([(k, t, "x") for k, t in texts], TEXTS)
    spans = spark.createDataFrame(functions, "doc_id long, line_start int, line_end int") if functions else None
    out = source_rules.evaluate(rows, rules, "doc_id", "text", spans).collect()
    return sorted(((r.doc_id, r.rule_id, r.segment, r.line, r.col, r.start, r.evidence) for r in out), key=str)


def test_places_in_texts_with_wide_characters_and_crlf(spark):
    texts = [(1, "\U0001f600\r\nab hit\r\n\r\nhit\U0001f600hit"), (2, None), (3, ""), (None, "hit"), (4, "a\nhi\nt")]
    rule = SourceRule("R", primary=("hit|hi\\nt",))
    assert found(spark, texts, [rule]) == sorted([
        (1, "R", 1, 2, 4, 6, "hit"), (1, "R", 1, 4, 1, 13, "hit"), (None, "R", 1, 1, 1, 0, "hit"), (4, "R", 1, 2, 1, 2, "hi\nt"),
    ], key=str)


def test_several_primaries_required_and_excluded(spark):
    rule = SourceRule("R", primary=("a", "b"), required=("c",), excluded=("d",))
    texts = [(1, "abc"), (2, "ab"), (3, "ac"), (4, "abcd"), (5, "cbaaaa")]
    assert [r[:6] for r in found(spark, texts, [rule])] == [(1, "R", 1, 1, 1, 0), (5, "R", 1, 1, 3, 2), (5, "R", 1, 1, 4, 3)]


def test_functions_are_segments(spark):
    text = "x\ndef f\n x\n y\ndef g\n x x x\nx"
    rule = SourceRule("R", primary=("x",), within="function")
    spans = [(1, 2, 4), (1, 2, 4), (1, 5, 6), (1, 90, 99)]
    assert [r[:6] for r in found(spark, [(1, text), (2, "x")], [rule], spans)] == [(1, "R", 2, 3, 2, 9), (1, "R", 5, 6, 2, 21), (2, "R", 1, 1, 1, 0)]


def test_guards_in_the_window_above(spark):
    rule = SourceRule("R", definition=r"def \w+", guard="@login")
    near, far = "@login\ndef a\n", "@login" + "\n" * 520 + "def b\n"
    got = found(spark, [(1, near), (2, far), (3, "def c"), (4, "@login " + "x" * 600 + "\ndef d")], [rule])
    # 4: no line stands above the definition's, so the window begins with the text
    assert [(r[0], r[6]) for r in got] == [(2, "def b"), (3, "def c")]
    # the window begins 500 characters before the line break above the definition's line
    exact = [(5, "@login" + "y" * 494 + "\nq\ndef e"), (6, "@login" + "y" * 500 + "\nq\ndef f")]
    assert [r[0] for r in found(spark, exact, [rule])] == [6]


def test_random_texts_equal_a_plain_count(spark):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("ab\n\r\U0001f600é") for _ in range(rng.randint(0, 200)))) for k in range(60)]
    want = []
    for k, t in texts:
        at, n = t.find("ab"), 0
        while at >= 0 and n < 2:
            want.append((k, "R", 1, t.count("\n", 0, at) + 1, at - t.rfind("\n", 0, at), at, "ab"))
            at, n = t.find("ab", at + 1), n + 1
    assert found(spark, texts, [SourceRule("R", primary=("ab",))]) == sorted(want, key=str)


def test_a_very_long_text_costs_its_length():
    text = "line of code\n" * 400_000 + "needle"
    began = time.process_time()
    assert source_rules._found(text, [SourceRule("R", primary=("needle",))], [])[0][1:4] == (1, 400_001, 1)
    assert time.process_time() - began < 5
