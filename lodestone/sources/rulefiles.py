"""Rule files: JSON, or YAML where a reader is installed, checked whole on the driver; a rule is a row of settings, never a table that grows."""

from __future__ import annotations

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import replace

from lodestone.operators.calls import CallRule, Option

#: The languages that rules can ask for.
LANGUAGES = ("go", "java", "javascript", "kotlin", "python", "rust", "swift", "typescript")
SEVERITIES = ("critical", "high", "medium", "low")
_TEXTS = {"callee", "receiver", "arguments", "without", "message", "severity", "disposition"}
_LISTS = {"missing", "context", "no_context", "languages"}
FIELDS = {"id", "enabled", "whole", "index", "option", "confidence"} | _TEXTS | _LISTS
#: Names that the same settings have in rule files written for other scanners of calls.
ALSO = {"args_match": "arguments", "args_match_index": "index", "args_exclude": "without", "missing_args": "missing", "boolean_option": "option", "receiver_match": "receiver", "callee_match": "callee"}


def _documents(text: str) -> list[dict]:
    """The rules of a file: a list, a mapping with ``rules``, or one rule."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML reader is installed") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("neither JSON nor YAML") from e
    if not found:
        return []
    found = found["rules"] if isinstance(found, dict) and "rules" in found else found
    found = found if isinstance(found, list) else [found]
    if not all(isinstance(x, dict) for x in found):
        raise ValueError("a rule is a mapping")
    return found


def rule_of(data: dict) -> CallRule | None:
    """One rule; None if it asks for languages only that nothing is read in.  Unknown settings, broken patterns and odd values are errors."""
    data = {ALSO.get(k, k): v for k, v in data.items()}
    if unknown := data.keys() - FIELDS:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if not isinstance(data.get("id"), str) or not data["id"]:
        raise ValueError("a rule has an id")
    many = {k: tuple(data[k]) if isinstance(data[k], list) else (data[k],) for k in _LISTS & data.keys()}
    if not all(isinstance(x, str) for v in many.values() for x in v) or not all(isinstance(data[k], str) for k in _TEXTS & data.keys()):
        raise ValueError("a text is expected")
    for pattern in [data[k] for k in ("callee", "receiver", "arguments", "without") if k in data] + [x for k in ("missing", "context", "no_context") for x in many.get(k, ())]:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a pattern: {pattern}") from e
    if data.get("severity", "medium") not in SEVERITIES or not 0 <= data.get("confidence", 0.7) <= 1:
        raise ValueError("severity or confidence out of range")
    option = Option(**{**data["option"], "states": tuple(data["option"]["states"])}) if "option" in data else None
    asked = many.pop("languages", ())
    languages = tuple(x for x in asked if x in LANGUAGES)
    if asked and not languages:
        return None
    rest = {k: data[k] for k in ("callee", "whole", "receiver", "arguments", "index", "without", "severity", "confidence", "disposition", "message", "enabled") if k in data}
    return CallRule(data["id"], languages, option=option, **many, **rest)


def load(files: Iterable[tuple[str, str]]) -> tuple[list[CallRule], list[tuple[str, str]]]:
    """The enabled rules of (path, text), and (path, problem) for files and rules that can't be used.  Of one id the last counts, in the order of the paths."""
    rules, problems = {}, []
    for path, text in sorted(files):
        try:
            documents = _documents(text)
        except ValueError as e:
            problems.append((path, str(e)))
            continue
        for data in documents:
            try:
                rule = rule_of(data)
            except (KeyError, TypeError, ValueError) as e:
                problems.append((path, f"{data.get('id', '?')}: {e}"))
                continue
            if rule:
                rules[rule.rule_id] = rule
    return [r for r in rules.values() if r.enabled], problems


class Registry:
    """Rules by id: the last one registered under an id counts; some may be switched off.  A value that is passed on, nothing global."""

    def __init__(self, rules: Iterable[CallRule] = ()):
        self.rules = {r.rule_id: r for r in rules}

    def with_rule(self, rule: CallRule) -> Registry:
        return Registry([*self.rules.values(), rule])

    def without(self, *ids: str) -> Registry:
        return Registry(replace(r, enabled=r.enabled and r.rule_id not in ids) for r in self.rules.values())

    def of(self, language: str | None = None) -> list[CallRule]:
        """The enabled rules, or those of a language."""
        return [r for r in self.rules.values() if r.enabled and (language is None or not r.languages or language in r.languages)]
