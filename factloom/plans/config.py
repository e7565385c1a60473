"""Configuration of rules: its JSON schema from the registered rules, and what is wrong with a configuration."""

from __future__ import annotations

from difflib import get_close_matches

from factloom.functions.scalars import COST_PRESETS, LABELS
from factloom.plans.rules import Rule

# Settings beside the rule sets, with their types.
GENERAL = {"config": {"validation": "boolean", "warningsAsErrors": "boolean"}, "maxCost": [*LABELS["cost"], *[p for p in COST_PRESETS if p != "all"]], "testSourcePaths": "strings", "testSourcePathsOverride": "strings"}
# Settings that every rule has.
COMMON = {"active": "boolean", "severity": ["error", "warning", "info"], "excludes": "strings"}


def _schema(kind) -> dict:
    if isinstance(kind, list):
        return {"type": "string", "enum": kind}
    if isinstance(kind, dict):
        return {"type": "object", "properties": {k: _schema(v) for k, v in kind.items()}, "additionalProperties": False}
    return {"type": "array", "items": {"type": "string"}} if kind == "strings" else {"type": kind}


def config_schema(rules: dict[str, Rule], options: dict[str, dict] | None = None) -> dict:
    """A JSON schema: general settings, and for each rule set its rules with their settings; ``options`` has those of single rules."""
    properties = {k: _schema(v) for k, v in GENERAL.items()}
    for r in sorted(rules.values(), key=lambda r: (r.rule_set, r.id)):
        of_set = properties.setdefault(r.rule_set, {"type": "object", "properties": {"active": {"type": "boolean"}}, "additionalProperties": False})
        of_set["properties"][r.id] = _schema(COMMON | (options or {}).get(r.id, {}))
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": properties}


def _fits(value: object, schema: dict) -> bool:
    kind = schema["type"]
    if kind == "array":
        return isinstance(value, list) and all(_fits(v, schema["items"]) for v in value)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, str) and value in schema.get("enum", [value])


def validate_config(config: dict, schema: dict, path: str = "") -> list[tuple[str, str, str]]:
    """(path, message, level) of what a configuration has wrong, in order of its paths.

    Unknown keys at the top are warnings, below it errors, with the nearest
    known key; a rule set or rule that isn't a map is left alone, as an empty one.
    """
    out = []
    for key in sorted(config, key=str):
        at, known = f"{path}.{key}" if path else str(key), schema["properties"]
        if key not in known:
            near = get_close_matches(str(key), list(known), 1)
            out.append((at, f"unknown key '{key}'" + (f", did you mean '{near[0]}'?" if near else ""), "error" if path else "warning"))
        elif known[key]["type"] == "object":
            if isinstance(config[key], dict):
                out += validate_config(config[key], known[key], at)
            elif config[key] is not None:
                out.append((at, f"expected object, got {type(config[key]).__name__}", "error"))
        elif not _fits(config[key], known[key]):
            wanted = f"one of {', '.join(known[key]['enum'])}" if "enum" in known[key] else known[key]["type"]
            out.append((at, f"expected {wanted}, got {config[key]!r}", "error"))
    return out
