"""Category rules: the built-in set, JSON rule files, layering and validation."""

from __future__ import annotations

import json
import re

VERSION = "0.1.0"
_BUILT_IN = {
    "source": ("extension", "rs py hxx hpp hh h cxx cpp cc c"),
    "documentation": ("extension", "rst md markdown adoc"),
    "configuration": ("filename", "tsconfig.json pyproject.toml package.json Cargo.toml Cargo.lock loam.json"),
    "data": ("extension", "tsv parquet jsonl csv"),
    "assets": ("extension", "woff2 woff webp ttf svg png pdf otf mp4 mp3 jpg jpeg ico gif avif"),
}
#: (category, kind, value, exclude)
Rule = tuple[str, str, str, bool]
DEFAULT_RULES: list[Rule] = [(c, kind, v, False) for c, (kind, values) in _BUILT_IN.items() for v in values.split()]
CATEGORIES = (*_BUILT_IN, "uncategorized")
FIELDS = {"include_extensions": ("extension", False), "include_filenames": ("filename", False), "include_filename_regexes": ("regex", False), "exclude_filenames": ("filename", True), "exclude_filename_regexes": ("regex", True)}
_NOT_PORTABLE = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=")


class RuleError(ValueError):
    """A rule file that can't be used."""


def parse(text: str) -> dict:
    """A rule file's content; unknown keys and other versions are errors."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise RuleError(f"not JSON: {e}") from None
    _keys(raw, {"config_version", "inventory"}, "rule file")
    if raw.get("config_version") != VERSION:
        raise RuleError(f"config_version must be {VERSION}, not {raw.get('config_version')!r}")
    part = raw.get("inventory") or {}
    _keys(part, {"ignore_defaults", "categories"}, "inventory")
    for name, rule in (part.get("categories") or {}).items():
        if name not in CATEGORIES or name == "uncategorized":
            raise RuleError(f"unknown category {name!r}")
        _keys(rule, {"mode", *FIELDS}, f"category {name}")
        if rule.get("mode", "extend") not in ("extend", "replace"):
            raise RuleError(f"mode of {name} must be extend or replace")
    return part


def _keys(raw: object, known: set[str], where: str) -> None:
    if not isinstance(raw, dict):
        raise RuleError(f"{where} must be an object")
    if extra := sorted(set(raw) - known):
        raise RuleError(f"{where} has unknown keys: {', '.join(extra)}")


def layered(texts: list[str]) -> tuple[list[Rule], list[str]]:
    """Rules of the built-in set and rule files in order, and warnings.

    A category extends what lies below or replaces it; ignore_defaults clears all, after which extending
    has nothing to extend, which is worth a warning.
    """
    rules: list[Rule] = list(DEFAULT_RULES)
    warnings: list[str] = []
    for text in texts:
        part = parse(text)
        if part.get("ignore_defaults"):
            rules = []
        for name, rule in (part.get("categories") or {}).items():
            if rule.get("mode") == "replace":
                rules = [r for r in rules if r[0] != name]
            elif rule.get("mode") == "extend" and part.get("ignore_defaults"):
                warnings.append(f"config-child-extend-ignored: {name} has nothing to extend")
            for field, (kind, exclude) in FIELDS.items():
                rules += [(name, kind, v, exclude) for v in rule.get(field) or []]
    validate(rules)
    return sorted(set(rules)), warnings


def validate(rules: list[Rule]) -> None:
    """Shapes of selectors, none claimed by two categories, none both included and excluded."""
    owner: dict[tuple[str, str], str] = {}
    for category, kind, value, exclude in rules:
        if not value:
            raise RuleError(f"{category}: empty {kind}")
        if kind == "extension" and (value.startswith(".") or "/" in value or value != value.lower()):
            raise RuleError(f"{category}: extension {value!r} must be lower case, without dot or slash")
        if kind == "filename" and "/" in value:
            raise RuleError(f"{category}: file name {value!r} must have no slash")
        if kind == "regex":
            if _NOT_PORTABLE.search(value):
                raise RuleError(f"{category}: pattern {value!r} uses look-around or back-references")
            try:
                re.compile(value)
            except re.error as e:
                raise RuleError(f"{category}: pattern {value!r}: {e}") from None
        if not exclude and kind != "regex" and owner.setdefault((kind, value), category) != category:
            raise RuleError(f"{kind} {value!r} is claimed by {owner[kind, value]} and {category}")
        if (category, kind, value, not exclude) in rules:
            raise RuleError(f"{category}: {kind} {value!r} is both included and excluded")
