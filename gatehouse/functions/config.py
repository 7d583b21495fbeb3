"""Validation of consistency configurations: one small closed JSON document a repository."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from posixpath import normpath
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Any], bool]
MODES = ("shadow", "ratchet", "enforce")
DDL = (
    "mode string, include array<string>, has_contracts boolean, required_paths array<string>, commands array<struct<text:string,paths:array<string>>>,"
    " impact array<struct<change:array<string>,requires_any:array<string>,exempt:boolean>>, artifacts array<struct<path:string,sources:array<string>,sha256:string>>, baseline array<string>"
)


def _text(value: Any) -> bool:
    return isinstance(value, str) and value != ""


def _inside(value: Any) -> bool:
    """A path that stays in the repository."""
    return _text(value) and not value.startswith("/") and normpath(value).split("/")[0] != ".."


def _list(rule: Rule, least: int = 0) -> Rule:
    return lambda v: isinstance(v, list) and len(v) >= least and all(map(rule, v))


def _record(needs: dict[str, Rule], may: dict[str, Rule]) -> Rule:
    every = needs | may
    return lambda v: isinstance(v, dict) and needs.keys() <= v.keys() <= every.keys() and all(every[k](x) for k, x in v.items())


def _config(schema_id: str) -> Rule:
    texts, paths = _list(_text), _list(_inside)
    command = _record({"text": _text}, {"paths": paths})
    impact = _record({"change": _list(_text, 1), "requires_any": _list(_text, 1)}, {"allow_github_action_ref_updates": lambda v: isinstance(v, bool)})
    artifact = _record({"path": _inside, "sha256": lambda v: _text(v) and re.fullmatch("[0-9a-f]{64}", v) is not None}, {"sources": texts})
    return _record(
        {"schema": lambda v: v == schema_id, "mode": lambda v: _text(v) and v in MODES},
        {
            "$schema": lambda v: isinstance(v, str),
            "markdown": _record({}, {"include": texts}),
            "readme_contracts": _record({}, {"required_paths": paths, "commands": _list(command)}),
            "impact_map": _list(impact),
            "generated_artifacts": _list(artifact),
            "ratchet": _record({"baseline": lambda v: texts(v) and len(set(v)) == len(v)}, {}),
        },
    )


def _normal(raw: bytes | None, rule: Rule, include: tuple[str, ...]) -> str | None:
    """The configuration's parts as JSON of ``DDL``; '' if it is not valid, None if there is none."""
    if raw is None:
        return None
    try:
        given = json.loads(bytes(raw).decode("utf-8"))
    except ValueError:
        return ""
    if not rule(given):
        return ""
    contracts = given.get("readme_contracts", {})
    return json.dumps(
        {
            "mode": given["mode"],
            "include": given.get("markdown", {}).get("include", list(include)),
            "has_contracts": "readme_contracts" in given,
            "required_paths": contracts.get("required_paths", []),
            "commands": [{"text": c["text"], "paths": c.get("paths", [])} for c in contracts.get("commands", [])],
            "impact": [{"change": r["change"], "requires_any": r["requires_any"], "exempt": r.get("allow_github_action_ref_updates", False)} for r in given.get("impact_map", [])],
            "artifacts": [{"path": a["path"], "sources": a.get("sources", []), "sha256": a["sha256"]} for a in given.get("generated_artifacts", [])],
            "baseline": given.get("ratchet", {}).get("baseline", []),
        }
    )


def parsed(content: Column, schema_id: str, include: tuple[str, ...] = ("README.md", "docs/**/*.md")) -> tuple[Column, Column]:
    """(whether a configuration is not valid, its parts as a struct of ``DDL``); both null where there is no content. ``content`` is bytes or text."""
    rule = _config(schema_id)
    normal = F.pandas_udf(lambda s: pd.Series([_normal(x, rule, include) for x in s], index=s.index, dtype=object), "string")(content.cast("binary"))
    return normal == "", F.when(normal != "", F.from_json(normal, DDL))
