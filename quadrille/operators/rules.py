"""Plain-Python rules for a single state, shared by the host-side loop and by stateful streaming."""

from __future__ import annotations

import json
import re

_ACT = re.compile(r"(?im)^\s*act\s*:\s*(?:output\s+)?(.+?)\s*$")


def parse_action(text: str) -> dict:
    """One JSON object from the act line (or the last line); anything else is an error."""
    m = _ACT.search(text)
    line = m[1] if m else (text.strip().splitlines() or [""])[-1]
    a, z = line.find("{"), line.rfind("}")
    if a < 0 or z < a:
        raise ValueError("the act holds no JSON object")
    value = json.loads(line[a : z + 1])
    if not isinstance(value, dict):
        raise ValueError("the act must be a JSON object")
    return value


def violations(spec, state: dict, action: dict) -> list[str]:
    """Reasons in order; true and false are no coordinates."""
    op = action.get("operation")
    if op not in spec.actions:
        return [f"unknown operation: {op}"]
    out = [f"missing required field: {k}" for k in spec.actions[op] if k not in action]
    entity = action.get("entity_id")
    if entity is not None and entity not in state.get("entities", {}):
        out.append(f"unknown entity_id: {entity}")
    target = action.get("target")
    if target is None:
        return out
    whole = isinstance(target, list) and len(target) == 2 and all(type(v) is int for v in target)
    if not whole:
        out.append("target must be [row, column] integer coordinates")
    elif spec.bounds and not all(0 <= v < b for v, b in zip(target, spec.bounds)):
        out.append("target is outside configured bounds")
    elif target in state.get(spec.blocked_key, []):
        out.append("target is blocked")
    return out
