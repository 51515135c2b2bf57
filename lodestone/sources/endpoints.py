"""Endpoints that sources declare, by decorators of their functions and by registrations in their text.

A text is read by one grammar, whatever its framework: a call with an optional marker before it (``@`` or ``#[``), an owner, a name, a first
string and the word that follows.  What such a call means is looked up in a table of frameworks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fn

#: The methods of HTTP that frameworks have a word for.
METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
_WORD = r"[A-Za-z_]\w*"
#: Marker, owner, name, string and next word of a call; a string and a word may be missing.
CALL = rf"""(@|#\[)?(?:({_WORD}(?:\.{_WORD})*)\.|\.)?({_WORD})\s*\((?:\s*(?:"([^"\n]*)"|'([^'\n]*)'|`([^`\n]*)`)\s*(?:,\s*({_WORD}))?)?"""


@dataclass(frozen=True)
class Framework:
    """How a framework registers: ``calls`` maps a call's name to a method, ``*`` reads the method from the word that follows.

    ``marker``: what stands before the call; ``owners``: None for any, () for none; ``handler``: whether a word has to follow; ``root``: whether
    the path begins with a slash; ``bare``: whether the path may be missing."""

    name: str
    languages: tuple[str, ...]
    calls: dict[str, str]
    marker: str = ""
    owners: tuple[str, ...] | None = None
    owned: bool = False
    handler: bool = False
    root: bool = False
    bare: bool = False


_lower = {m.lower(): m for m in METHODS}
_title = {m.title(): m for m in METHODS}
FRAMEWORKS = (
    Framework("Express", ("javascript", "typescript"), {**_lower, "all": "ALL"}, owners=("app", "router")),
    Framework("NestJS", ("typescript",), {**_title, "All": "ALL"}, marker="@", bare=True),
    Framework("net/http", ("go",), {"Handle": "ALL", "HandleFunc": "ALL"}, handler=True),
    Framework("Go router", ("go",), {**_lower, **_title, **{m: m for m in METHODS}, "Any": "ALL"}, owned=True, handler=True),
    Framework("Ktor", ("kotlin",), _lower, owners=(), root=True),
    Framework("Rust attribute", ("rust",), _lower, marker="#["),
    Framework("Axum", ("rust",), {"route": "*"}),
    Framework("Django", ("python",), {"path": "ALL", "re_path": "ALL"}, owners=(), handler=True),
)

#: What asks for a caller's identity, by the frameworks' own documentation: Django and Django REST, Flask extensions, FastAPI, NestJS, Spring and Jakarta.
GUARDS = (
    "login_required", "permission_required", "staff_member_required", "user_passes_test", "IsAdminUser", "IsAuthenticated",
    "auth_required", "fresh_login_required", "jwt_required", "roles_required",
    "Security(", "AuthGuard", "RolesGuard", "@PostAuthorize", "@PreAuthorize", "@RolesAllowed", "@Secured",
)
#: FastAPI has no word of its own for it: a dependency that is named after a user, a token or authentication.
_DEPENDENCY = r"Depends\(\s*\w*(?:auth|token|user)"


def _guarded(mark: Column) -> Column:
    return mark.rlike("|".join([*(rf"\Q{g}\E" for g in GUARDS), _DEPENDENCY]))


def _items(text: Column) -> Column:
    """Upper-case items of ``'a', "b"``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)), F.upper)


def _first(*found: Column) -> Column:
    """The first of several texts that isn't empty, null if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in found))


def _argument(mark: Column, *names: str) -> Column:
    """The string that a decorator has as its first argument or under one of ``names``; null if there is none."""
    given = rf"""\(\s*(?:(?:{"|".join(names)})\s*=\s*)?[\[{{]?\s*["']([^"']+)["']"""
    named = rf"""[(,]\s*(?:{"|".join(names)})\s*=\s*[\[{{]?\s*["']([^"']+)["']"""
    return _first(F.regexp_extract(mark, given, 1), F.regexp_extract(mark, named, 1))


def _mapping(mark: Column) -> tuple[Column, Column, Column]:
    """Whether an annotation is one of Spring's mappings, its path and its method."""
    kind = F.regexp_extract(mark, rf"^@(?:{_WORD}\.)*({_WORD})Mapping\b", 1)
    known = {**_title, "Request": "ALL"}
    method = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), kind)
    stated = F.nullif(F.regexp_extract(mark, r"\bmethod\s*=[^,)]*?\b([A-Z]+)\b", 1), F.lit(""))
    return method.isNotNull(), F.coalesce(_argument(mark, "value", "path"), F.lit("")), F.when(method == "ALL", F.coalesce(stated, method)).otherwise(method)


def _declared(mark: Column, framework: Column, name: Column) -> Column:
    """What a decorator declares: ``path``, ``methods``, ``framework``; null for others."""
    called = F.regexp_extract(mark, rf"^@({_WORD}(?:\.{_WORD})*)\s*\(", 1)
    word = F.element_at(F.split(called, r"\."), -1)
    path = _argument(mark, "rule", "path")
    listed = lambda key: _items(F.regexp_extract(mark, rf"{key}[\[(]([^\])]*)", 1))
    methods = listed(r"\bmethods\s*=\s*")
    made = lambda path, methods, by: F.struct(path.alias("path"), methods.alias("methods"), by.alias("framework"))
    of_python = framework.isNotNull() & F.contains(called, F.lit(".")) & path.isNotNull()
    spring, place, method = _mapping(mark)
    return (
        F.when(of_python & (word == "route"), made(path, F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("GET"))), framework))
        .when(of_python & F.upper(word).isin(*METHODS), made(path, F.array(F.upper(word)), framework))
        .when(word == "api_view", made(F.concat(F.lit("/"), name, F.lit("/")), listed(r"api_view\(\s*"), F.lit("Django")))
        .when(spring, made(place, F.array(method), F.lit("Spring")))
    )


def from_decorators(functions: DataFrame) -> DataFrame:
    """Endpoints of ``functions`` (``file_path``, ``name``, ``line_start``, ``decorators``, ``class_decorators``, ``modules``: what the file imports), one for each method.

    Python decorators count where the file imports their framework.  A Spring path follows its class's; null arrays are empty."""
    some = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    uses = lambda module: F.exists(some("modules"), lambda m: F.split_part(m, F.lit("."), F.lit(1)) == module)
    framework = F.when(uses("fastapi"), "FastAPI").when(uses("flask"), "Flask")
    marked = F.exists(F.concat(some("decorators"), some("class_decorators")), _guarded)
    found = functions.withColumns({"_fw": framework, "auth_required": marked}).withColumn("_d", F.explode("decorators")).withColumn("_e", _declared(F.col("_d"), F.col("_fw"), F.col("name")))
    prefixes = F.filter(F.transform(some("class_decorators"), lambda d: F.when(_mapping(d)[0], _mapping(d)[1])), lambda p: p.isNotNull())
    parts = F.transform(F.array(F.coalesce(F.get(prefixes, 0), F.lit("")), F.col("_e.path")), lambda p: F.btrim(p, F.lit("/")))
    joined = F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda p: p != ""), "/"))
    path = F.when((F.col("_e.framework") == "Spring") & F.isnotnull("class_decorators"), joined).otherwise(F.col("_e.path"))
    rows = found.filter("_e is not null").select("file_path", F.col("name").alias("handler"), "line_start", "auth_required", F.col("_e.framework").alias("framework"), path.alias("path"), F.explode("_e.methods").alias("method"))
    return rows.withColumn("params", fn.path_params(F.regexp_replace("path", "<(?:[^:<>]+:)?([^<>]+)>", "{$1}")))


def calls_in(text: Column) -> Column:
    """The calls of a text by ``CALL``: ``line``, ``marker``, ``owner``, ``name``, ``path`` (null: no string), ``next``.

    Lines are counted from call to call, so a text is read twice however many calls it has."""
    whole = F.regexp_extract_all(text, F.lit(CALL), F.lit(0))
    breaks = lambda s: F.regexp_count(s, F.lit("\n")).cast("int")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        line = acc["at"] + breaks(x["before"])
        return F.struct((line + breaks(x["call"])).alias("at"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    pieces = F.arrays_zip(F.slice(F.split(text, CALL, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("call"))
    lines = F.aggregate(pieces, start, step, lambda acc: acc["lines"])
    part = lambda call, k: F.regexp_extract(call, CALL, k)

    def read(z: Column) -> Column:
        c = z["call"]
        path = F.when(c.rlike("[\"'`]"), F.concat(part(c, 4), part(c, 5), part(c, 6)))
        return F.struct(z["line"].alias("line"), part(c, 1).alias("marker"), part(c, 2).alias("owner"), part(c, 3).alias("name"), path.alias("path"), part(c, 7).alias("next"))

    return F.transform(F.arrays_zip(whole.alias("call"), lines.alias("line")), read)


def _meaning(language: Column, call: Column) -> Column:
    """``framework``, ``method`` of a call by the first framework that it is one of; null for others."""
    kinds = []
    for f in FRAMEWORKS:
        fits = language.isin(*f.languages) & (call["marker"] == f.marker) & call["name"].isin(*f.calls)
        if f.owners is not None:
            fits &= call["owner"].isin(*f.owners) if f.owners else call["owner"] == ""
        if f.owned:
            fits &= call["owner"] != ""
        if f.handler:
            fits &= call["next"] != ""
        fits &= F.startswith(call["path"], F.lit("/")) if f.root else F.lit(True) if f.bare else call["path"] != ""
        method = F.element_at(F.create_map(*(F.lit(x) for pair in f.calls.items() for x in pair)), call["name"])
        if "*" in f.calls.values():
            method, fits = F.upper(call["next"]), fits & call["next"].isin(*_lower)
        kinds.append(F.when(fits, F.struct(F.lit(f.name).alias("framework"), method.alias("method"))))
    return F.coalesce(*kinds)


def from_sources(files: DataFrame) -> DataFrame:
    """Registrations in ``files`` (``file_path``, ``language``, ``text``): ``file_path``, ``framework``, ``method``, ``path``, ``line``.

    One scan without a shuffle; texts of other languages are not read, they and null texts give no rows."""
    spoken = sorted({x for f in FRAMEWORKS for x in f.languages})
    rows = files.filter(F.col("language").isin(*spoken) & F.col("text").isNotNull())
    rows = rows.select("file_path", "language", F.explode(calls_in(F.col("text"))).alias("c")).withColumn("m", _meaning(F.col("language"), F.col("c")))
    return rows.filter("m is not null").select("file_path", "m.framework", "m.method", F.coalesce("c.path", F.lit("")).alias("path"), "c.line")
