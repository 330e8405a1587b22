"""Rules, segments and deny lists read from configuration text: YAML where its parser is installed, JSON always."""

from __future__ import annotations

import json
from typing import Any

from ..operators.quality_rules import BUILDERS, Rule
from ..operators.segments import Segment

def parse(text: str) -> Any:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ValueError("not JSON, and no YAML parser is installed") from e
    return yaml.safe_load(text)


def segments(text: str) -> list[Segment]:
    """Segments of ``{"segments": [{id, name, description, null_handling, rule_ast, thresholds}]}``, or of the list itself."""
    found = parse(text)
    found = found["segments"] if isinstance(found, dict) else found
    return [Segment(s["id"], s.get("name", ""), s["rule_ast"], s.get("thresholds") or {}, s.get("null_handling", "exclude"), s.get("description", "")) for s in found]


#: What a rule must and may have besides its type's own arguments.
_NEEDED, _OPTIONAL = {"id", "dimension", "type"}, {"name", "severity", "column", "columns", "applies_when", "threshold_dataset_fail_rate"}


def rule(entry: dict[str, Any]) -> Rule:
    """One rule; an entry that lacks an id, a dimension or a known type is refused by its id. Keys that no rule has are arguments of the type."""
    if missing := sorted(_NEEDED - entry.keys()):
        raise ValueError(f"rule {entry.get('id')} has no {', '.join(missing)}")
    if entry["type"] not in BUILDERS:
        raise ValueError(f"rule {entry['id']} is of the unknown type {entry['type']}")
    own = {k: v for k, v in entry.items() if k in _NEEDED | _OPTIONAL and v is not None}
    own["threshold"] = own.pop("threshold_dataset_fail_rate", None)
    own["columns"] = tuple(own.get("columns", ()))
    listed = {k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k not in _NEEDED | _OPTIONAL}
    return Rule(**{"name": "", **own}, args=listed)


def rules(text: str) -> dict[str, list[Rule]]:
    """Rules by dataset. The format is ``{"datasets": {name: {"rules": [entry, ...]}}}`` and no other; ids must differ within a dataset."""
    found = parse(text)
    if not isinstance(found, dict) or not isinstance(found.get("datasets"), dict):
        raise ValueError("no mapping of datasets")
    out = {}
    for dataset, body in found["datasets"].items():
        if not isinstance(body, dict) or not isinstance(body.get("rules"), list):
            raise ValueError(f"dataset {dataset} has no list of rules")
        out[dataset] = [rule(e) for e in body["rules"]]
        if len({r.id for r in out[dataset]}) < len(out[dataset]):
            raise ValueError(f"dataset {dataset} repeats the id of a rule")
    return out


def denied(text: str) -> tuple[list[str], list[str]]:
    """Identifiers and local parts of e-mail addresses that name nobody: every list under a key that speaks of local parts is of the latter."""
    values: list[str] = []
    locals_: list[str] = []

    def walk(node: Any, name: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, str(k))
        elif isinstance(node, list):
            (locals_ if "local" in name else values).extend(str(x).lower() for x in node)

    walk(parse(text), "")
    return values, locals_
