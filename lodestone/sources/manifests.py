"""Small hand-written files that are checked whole on the driver before any work starts: workspaces and flow models."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More models than this are an error: the table is broadcast.
MAX_MODELS = 10_000
# What a model may be and what it may say.
ROLES = ["source", "sink", "propagator", "sanitizer"]
MODEL = {"id", "role", "languages", "callee", "receiver_types", "inputs", "outputs", "source_type", "sink_type", "argument_index", "sanitizes"}
REPOSITORY = {"id", "path", "role", "exclude", "depends_on"}


def parsed(text: str) -> dict:
    """JSON, or YAML where a YAML reader is installed; anything but a mapping is an error."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML reader is installed") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping is expected")
    return found


def _only(given: dict, allowed: set[str], needed: set[str], what: str) -> None:
    if unknown := given.keys() - allowed:
        raise ValueError(f"{what}: unknown fields {sorted(unknown)}")
    if missing := needed - given.keys():
        raise ValueError(f"{what}: missing fields {sorted(missing)}")


def workspace(spark: SparkSession, text: str, folder: str) -> DataFrame:
    """The repositories of a workspace of version 1: ``id``, ``path`` (relative ones are below ``folder``), ``role``, ``exclude``, ``depends_on``.

    Unknown fields, an id or path that occurs twice, an odd id, an empty list and a dependency on itself or on what is not there are errors."""
    given = parsed(text)
    _only(given, {"version", "name", "repositories"}, {"repositories"}, "workspace")
    if given.get("version", 1) != 1:
        raise ValueError(f"version {given['version']} is not supported")
    rows = []
    for r in given["repositories"]:
        _only(r, REPOSITORY, {"id", "path"}, "repository")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", r["id"]):
            raise ValueError(f"odd repository id {r['id']!r}")
        rows.append((r["id"], posixpath.normpath(posixpath.join(folder, r["path"])), r.get("role", "service"), r.get("exclude", []), r.get("depends_on", [])))
    ids, paths = [r[0] for r in rows], [r[1] for r in rows]
    if not rows or len(set(ids)) < len(ids) or len(set(paths)) < len(paths):
        raise ValueError("no repository, or one that occurs twice")
    if bad := [r[0] for r in rows if r[0] in r[4] or set(r[4]) - set(ids)]:
        raise ValueError(f"dependencies of {bad} on themselves or on unknown repositories")
    return spark.createDataFrame(rows, "id string, path string, role string, exclude array<string>, depends_on array<string>")


def models(spark: SparkSession, text: str) -> DataFrame:
    """Flow models of a pack: ``id``, ``role``, ``languages``, ``callee``, ``receiver_types`` (empty: any), ``kind``, ``argument_index``, ``sanitizes``."""
    rows = []
    for m in parsed(text).get("models", []):
        _only(m, MODEL, {"id", "role", "languages", "callee"}, "model")
        if m["role"] not in ROLES or (m["role"] == "sink") != ("sink_type" in m) or (m["role"] == "source") != ("source_type" in m):
            raise ValueError(f"model {m['id']}: the role and what it says do not fit")
        rows.append((m["id"], m["role"], m["languages"], m["callee"], m.get("receiver_types", []), m.get("source_type") or m.get("sink_type"), m.get("argument_index"), m.get("sanitizes", [])))
    if len({r[0] for r in rows}) < len(rows) or len(rows) > MAX_MODELS:
        raise ValueError("a model occurs twice, or there are too many")
    return spark.createDataFrame(rows, "id string, role string, languages array<string>, callee string, receiver_types array<string>, kind string, argument_index int, sanitizes array<string>")


def modelled(calls: DataFrame, pack: DataFrame) -> DataFrame:
    """``calls`` (``callee``, ``language``, ``receiver``) beside each model that fits: ``model_id``, ``role``, ``kind``.

    A model of certain receivers fits no call of an unknown one.  The pack is bounded (``MAX_MODELS``), so it is broadcast and the calls are not moved."""
    m = F.broadcast(pack.select(F.col("id").alias("model_id"), "role", "kind", F.explode("languages").alias("language"), "callee", "receiver_types"))
    fits = (F.size("receiver_types") == 0) | F.array_contains("receiver_types", F.col("receiver"))
    return calls.join(m, ["language", "callee"]).filter(fits).drop("receiver_types")
