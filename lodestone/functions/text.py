"""Scalar functions over paths, code and messages, as column expressions."""

from __future__ import annotations

import functools
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# What counts as a secret in a text, and the mark that takes its place.
SECRET_PATTERNS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"[Bb]earer [A-Za-z0-9._-]+",
    r"AKIA[0-9A-Z]{16}",
    r"sk-[A-Za-z0-9]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"(?i)(password|secret|token|api_key)\s*=\s*[^\s&]+",
]
REDACTED = "[REDACTED]"


def client_path(url: Column) -> Column:
    """The path that a client asks for: holes become ``{dynamic}``; origin, query and fragment go; slashes collapse."""
    holes = F.regexp_replace(url, r"\$\{[^}]*\}", "{dynamic}")
    bare = F.regexp_replace(F.regexp_replace(holes, "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    return F.regexp_replace(bare, "/+", "/")


def canonical_template(path: Column) -> Column:
    """``<t:x>``, ``:x`` and ``{x}`` as ``{}``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "<[^>]*>", "{}"), ":[A-Za-z_][A-Za-z0-9_]*", "{}"), r"\{[^}]*\}", "{}")


def path_params(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\{([^}]*)\}"), F.lit(1))


def segments(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def first_literal(path: Column) -> Column:
    """The first segment, as written."""
    return F.split_part(path, F.lit("/"), F.lit(2))


def template_regex(path: Column) -> Column:
    """A regular expression for a template: parameters are one segment, all else is literal."""
    quoted = F.regexp_replace(path, r"([.+*?^$()\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^}]*\}", "[^/]+"), F.lit("$"))


def ant_regex(pattern: str) -> str:
    """``**`` any path, ``*`` within a segment, ``?`` one character."""
    out = ""
    at = 0
    while at < len(pattern):
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + ("\\" if pattern[at] in r".+^$()[]{}|\\" else "") + pattern[at], at + 1
    return f"^{out}$"


def scrub_strings(code: Column) -> Column:
    """Contents of double-quoted strings as blanks of the same length, so that offsets hold."""
    pieces = F.split(code, '"', -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), '"')


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
    n = F.size(chars).cast("double")
    return F.coalesce(-F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k / n * F.log2(k / n)), F.lit(0.0))


def severity_of(score: Column) -> Column:
    """A numeric score as a severity."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def cwe(tags: Column) -> Column:
    return F.regexp_extract(F.lower(tags), "cwe[-_/]?0*([0-9]+)", 1)


def normal_path(path: Column) -> Column:
    """Without scheme, empty and ``.`` segments; null where ``..`` or a control character occurs."""
    bare = F.regexp_replace(path, "^[a-z]+://", "")
    parts = F.filter(F.split(bare, "/"), lambda p: (p != "") & (p != "."))
    bad = F.exists(parts, lambda p: p == "..") | bare.rlike("[\x01-\x1f]")
    return F.when(~bad, F.array_join(parts, "/"))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


#: Fixed value: the two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The score interval at 95 %, within 0 and 1; null where ``n`` is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits / n, Z95 * Z95
    centre, spread = p + z2 / (2 * n), F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * Z95
    return F.greatest((centre - spread) / (1 + z2 / n), F.lit(0.0)), F.least((centre + spread) / (1 + z2 / n), F.lit(1.0))


def evidence_id(prefix: str, *parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32))


def annotation_name(annotation: Column) -> Column:
    """``@Name`` of ``@a.b.Name(...)`` and of ``@get:Name``; empty where there is no annotation."""
    name = F.substring_index(F.regexp_extract(annotation, r"^\s*@(?:\w+:)?([\w.$]+)", 1), ".", -1)
    return F.when(name != "", F.concat(F.lit("@"), name)).otherwise("")


def annotation_strings(annotation: Column) -> Column:
    """The distinct string literals, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(annotation, F.lit(r"""["']([^"']+)["']"""), F.lit(1))))


# The escapes of a JavaScript string, and the pieces that a string is made of.
_ESCAPES = ("nrtbfv", "\n\r\t\b\f\v")
_PIECE = r"\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\\r\n|\\[\r\n]|\\0(?![0-9])|\\[^ux0-9\r\n]|[^\\]+"


def decode_escapes(text: Column) -> Column:
    """A JavaScript string without its escapes; null where an escape is broken, octal, beyond Unicode or half of a surrogate pair."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))

    def plain(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"^\\(?:u\{|u|x)([0-9a-fA-F]+)", 1)
        number = F.conv(code, 16, 10).cast("int")
        char = F.when((number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        named = F.translate(F.substring(piece, 2, 1), *_ESCAPES)
        single = F.when(piece == "\\0", "\x00").when(piece.rlike(r"^\\[\r\n]"), "").otherwise(named)
        return F.when(code != "", char).when(F.startswith(piece, F.lit("\\")), single).otherwise(piece)

    decoded = F.transform(pieces, plain)
    whole = F.length(F.array_join(pieces, "")) == F.length(text)
    return F.when(whole & ~F.exists(decoded, lambda d: d.isNull()), F.array_join(decoded, ""))


def every_param(path: Column) -> Column:
    """The parameters of a path in its order: ``{x}``, ``<x>``, ``<type:x>`` and ``:x``."""
    form = r"\{(\w+)\}|<(?:\w+:)?(\w+)>|:(\w+)"
    return F.transform(F.regexp_extract_all(path, F.lit(form), F.lit(0)), lambda m: F.concat(*(F.regexp_extract(m, form, k) for k in (1, 2, 3))))


def next_route(file_path: Column) -> Column:
    """The path that an ``app/.../route.ts`` file serves: groups in parentheses go, ``[x]`` is ``:x``, ``[...x]`` and ``[[...x]]`` are ``:x*``; ``/`` for other files."""
    inner = F.regexp_extract(F.replace(file_path, F.lit("\\"), F.lit("/")), r"(?:^|/)app/(.+)/route\.[jt]sx?$", 1)
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$"))
    shown = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\[{1,2}\.{3}([^\]]+)\]{1,2}$", ":$1*"), r"^\[([^\]]+)\]$", ":$1"))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


def joined_components(arguments: Column) -> Column:
    """The path of string arguments up to ``use:``: one that begins with a slash as it is, else all of them joined; empty without any."""
    found = F.regexp_extract_all(F.split_part(arguments, F.lit("use:"), F.lit(1)), F.lit(r"""["']([^"']+)["']"""), F.lit(1))
    joined = F.concat(F.lit("/"), F.array_join(F.transform(found, lambda p: F.btrim(p, F.lit("/"))), "/"))
    return F.when(F.size(found) == 0, "").when((F.size(found) == 1) & F.startswith(F.get(found, 0), F.lit("/")), F.get(found, 0)).otherwise(joined)


def symbol_parts(symbol: Column) -> Column:
    """A symbol's ``scheme``, ``manager``, ``name``, ``version``, ``descriptors``, or its ``local`` id; null where it is no symbol.

    Fields are parted by single blanks, a blank within a field is doubled, and the descriptors are all that follows the fourth field."""
    field = r"((?:[^ ]|  )*)"
    form = rf"^{field} {field} {field} {field} (?! )(.+)$"
    part = lambda k: F.replace(F.regexp_extract(symbol, form, k), F.lit("  "), F.lit(" "))
    none = F.lit(None).cast("string")
    names = ("scheme", "manager", "name", "version")
    whole = F.struct(*(part(k + 1).alias(n) for k, n in enumerate(names)), F.regexp_extract(symbol, form, 5).alias("descriptors"), none.alias("local"))
    local = F.struct(F.lit("local").alias("scheme"), *(none.alias(n) for n in names[1:]), none.alias("descriptors"), F.regexp_extract(symbol, "^local (.+)$", 1).alias("local"))
    fine = symbol.rlike(form) & ~F.startswith(symbol, F.lit("local"))
    for k in range(1, 5):
        fine &= part(k) != ""
    return F.when(symbol.rlike("^local .+"), local).when(fine, whole)


def level_of(score: Column, level: Column) -> Column:
    """A severity by a numeric score above 0, else by a level's name; low where both say nothing."""
    number, name = F.coalesce(score.try_cast("double"), F.lit(0.0)), F.lower(F.coalesce(level, F.lit("")))
    by_score = F.when(number > 9, "critical").when(number >= 7, "high").when(number >= 4, "medium").when(number > 0, "low")
    return F.coalesce(by_score, F.when(name == "critical", "critical").when(name.isin("error", "high"), "high").when(name.isin("warning", "medium"), "medium"), F.lit("low"))


# What a stated precision is worth, and what an unknown one is.
PRECISIONS = {"very-high": 0.98, "very_high": 0.98, "high": 0.9, "medium": 0.75, "low": 0.55}
OTHER_PRECISION = 0.8


def precision_of(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PRECISIONS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.coalesce(name, F.lit("")))), F.lit(OTHER_PRECISION))


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as ``\\uXXXX``, a surrogate pair where it takes two; ``to_json`` of a struct with sorted fields is compact already."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    code = lambda u: F.conv(u, 16, 10).cast("int")
    return F.array_join(F.transform(units, lambda u: F.when(code(u) < 127, F.char(code(u))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")


@F.pandas_udf(BooleanType())
def strict_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON object without a repeated key, NaN or a number that is not finite, at any depth; null is not."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def number(x: str) -> float:
        if not math.isfinite(float(x)):
            raise ValueError("not finite")
        return float(x)

    def refuse(x: str) -> None:
        raise ValueError(x)

    def one(text: str | None) -> bool:
        try:
            return isinstance(json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=refuse), dict)
        except (TypeError, ValueError, RecursionError):
            return False

    return texts.map(one)


def strict_date(text: Column) -> Column:
    """A day ``YYYY-MM-DD`` or a UTC time with milliseconds, that exists; null for others."""
    day, moment = text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    made = F.when(day | moment, F.try_to_timestamp(text))
    shown = F.when(day, F.date_format(made, "yyyy-MM-dd")).otherwise(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.when(shown == text, made)


#: Where tests live and how they are named, by the habits of pytest, unittest, Jest, JUnit and Go.
TEST_FOLDERS = ("__tests__", "fixtures", "spec", "test", "testdata", "tests")
TEST_ENDINGS = ("_test.go", "_test.py", ".spec.js", ".spec.ts", ".test.js", ".test.ts", "Test.java", "Test.kt", "Tests.java")


def is_test_file(path: Column) -> Column:
    bare = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.lower(F.substring_index(bare, "/", -1))
    inside = bare.rlike(rf"(^|/)({'|'.join(TEST_FOLDERS)})/")
    ends = [F.endswith(bare, F.lit(e)) for e in TEST_ENDINGS]
    return inside | F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("test-")) | functools.reduce(lambda a, b: a | b, ends)
