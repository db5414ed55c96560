"""Actions of a decision loop: validation against a specification, and the loop itself."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GRID_MOVES


@dataclass(frozen=True)
class Spec:
    """Operations with their required fields, and the size of the grid (None: unbounded)."""

    name: str
    actions: dict[str, tuple[str, ...]]
    bounds: tuple[int, int] | None = None
    description: str = ""
    blocked_key: str = "obstacles"
    goal_key: str = "goal"
    extra: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Spec:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        known = {"name", "actions", "bounds", "state_description", "blocked_key", "goal_key"}
        return cls(raw["name"], {k: tuple(v["required_fields"]) for k, v in raw["actions"].items()}, tuple(raw["bounds"]) if raw.get("bounds") else None,
                   raw.get("state_description", ""), raw.get("blocked_key", "obstacles"), raw.get("goal_key", "goal"), {k: v for k, v in raw.items() if k not in known})


def action_violations(spec: Spec, fields: Column, entities: Column, obstacles: Column) -> Column:
    """Ordered reasons against an action (fixed wording); an unknown operation is the only reason of its row.

    ``fields`` MAP<STRING, STRING> as parsed from JSON (``target`` a JSON list), ``entities`` ARRAY<STRING>,
    ``obstacles`` ARRAY<STRING> of ``row,column``.
    """
    op, entity, target = (F.element_at(fields, k) for k in ("operation", "entity_id", "target"))
    known = F.coalesce(op.isin(*spec.actions), F.lit(False))
    missing = [F.when((op == name) & ~F.map_contains_key(fields, k), F.lit(f"missing required field: {k}")) for name, need in spec.actions.items() for k in need]
    shape = target.rlike(r"^\[\s*-?\d+\s*,\s*-?\d+\s*\]$")
    row, col = (F.regexp_extract(target, r"^\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]$", i).try_cast("int") for i in (1, 2))
    inside = F.lit(True) if spec.bounds is None else row.between(0, spec.bounds[0] - 1) & col.between(0, spec.bounds[1] - 1)
    where = (F.when(~shape, "target must be [row, column] integer coordinates").when(~inside, "target is outside configured bounds")
             .when(F.array_contains(obstacles, F.concat_ws(",", row.cast("string"), col.cast("string"))), "target is blocked"))
    rest = F.array_compact(F.array(*missing, F.when(entity.isNotNull() & ~F.array_contains(entities, entity), F.concat(F.lit("unknown entity_id: "), entity)), F.when(target.isNotNull(), where)))
    return F.when(known, rest).otherwise(F.array(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("None")))))


def state_text(spec: Spec, entities: Column, obstacles: Column, goal: Column) -> Column:
    """Prompt text of a state; ``entities`` MAP<STRING, STRING> of JSON values, the others JSON text."""
    lines = F.transform(F.array_sort(F.map_entries(entities)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    ops = "; ".join(f"{n}({', '.join(k)})" for n, k in spec.actions.items())
    return F.concat_ws("\n", F.lit(f"Domain: {spec.name}"), F.lit(spec.description), F.lit("Current state:"), F.array_join(lines, "\n"), F.concat(F.lit("Blocked locations: "), obstacles), F.concat(F.lit("Goal: "), goal), F.lit(f"Allowed operations: {ops}"), F.lit("Return exactly one JSON action inside the Act stage."))


def walk(moves: Column, row: Column, col: Column, size: int, obstacles: Column, goal_row: Column, goal_col: Column, most: int = 100) -> Column:
    """STRUCT<row, col, steps, status> after a policy's moves on a grid.

    The first move that is unknown, leaves the grid or meets an obstacle stops
    the walk; so does reaching the goal.  Positions are ``row,column`` text in
    ``obstacles``.  Status: goal, NONE, invalid, outside, blocked, exceeded, open.
    """
    names = F.array(*map(F.lit, GRID_MOVES))
    dr, dc = (F.array(*[F.lit(m[i]) for m in GRID_MOVES.values()]) for i in (0, 1))
    state = lambda r, c, n, s: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), n.cast("int").alias("steps"), s.alias("status"))
    done = lambda r, c: F.when((r == goal_row) & (c == goal_col), "goal").otherwise("open")

    def step(s: Column, move: Column) -> Column:
        k = F.array_position(names, F.upper(F.trim(move))).cast("int")
        r, c = s["row"] + F.get(dr, k - 1), s["col"] + F.get(dc, k - 1)
        bad = (F.when(move == "NONE", "NONE").when(k == 0, "invalid").when((r < 0) | (c < 0) | (r >= size) | (c >= size), "outside")
               .when(F.array_contains(obstacles, F.concat_ws(",", r.cast("string"), c.cast("string"))), "blocked").when(s["steps"] >= most, "exceeded"))
        went = F.when(bad.isNotNull(), state(s["row"], s["col"], s["steps"], bad)).otherwise(state(r, c, s["steps"] + 1, done(r, c)))
        return F.when(s["status"] != "open", s).otherwise(went)

    return F.aggregate(moves, state(row, col, F.lit(0), done(row, col)), step)


def closed_loop(spec: Spec, state: dict, decide: Callable[[str], str], apply: Callable[[dict, dict], dict], most: int = 50) -> list[dict]:
    """Host-side loop for one state: encode, decide, validate, apply; an invalid action is never applied."""
    from .rules import parse_action, violations

    out = []
    for _ in range(most):
        if state.get("complete"):
            return out
        text = render_state(spec, state)
        action = parse_action(decide(text))
        reasons = violations(spec, state, action)
        out.append({"state_text": text, "action": action, "violations": reasons})
        if reasons:
            raise ValueError("unsafe action: " + "; ".join(reasons))
        state = apply(state, action)
    raise RuntimeError("the loop exceeded its steps")


def render_state(spec: Spec, state: dict) -> str:
    say = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)
    entities = [f"- {k}: {say(v)}" for k, v in sorted(state.get("entities", {}).items())]
    ops = "; ".join(f"{n}({', '.join(k)})" for n, k in spec.actions.items())
    return "\n".join([f"Domain: {spec.name}", spec.description, "Current state:", *entities, f"Blocked locations: {say(state.get(spec.blocked_key, []))}", f"Goal: {say(state.get(spec.goal_key))}", f"Allowed operations: {ops}", "Return exactly one JSON action inside the Act stage."])


def validated(actions: DataFrame, spec: Spec, name: str = "violations") -> DataFrame:
    """Adds the violations of ``fields`` against ``entities`` and ``obstacles`` columns."""
    return actions.withColumn(name, action_violations(spec, F.col("fields"), F.col("entities"), F.col("obstacles")))
