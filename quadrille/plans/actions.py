"""Actions, decision loops, grids, synthetic tasks, loss masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import actions, generators, masks
from ..operators.grid import grid_path
from .registry import query, table

SPEC = actions.Spec("warehouse", {"move": ("entity_id", "target"), "wait": ("entity_id",), "report": ()}, (10, 12), "A small warehouse.")

FIELDS = """a AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'wait' WHEN 'signup' THEN 'report' ELSE 'fly' END AS op, CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 'ghost' ELSE 'robot' END AS entity,
 CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '[true, 1]' ELSE '[' || (event_id % 12) || ', ' || (user_id % 14) || ']' END AS target, event_id % 12 AS r, user_id % 14 AS c FROM events)"""


@query("action_violations", f"""WITH {FIELDS} SELECT id, CASE WHEN op = 'fly' THEN 'unknown operation: fly' ELSE concat_ws(';', CASE WHEN op IN ('move', 'wait') AND entity IS NULL THEN 'missing required field: entity_id' END, CASE WHEN op = 'move' AND target IS NULL THEN 'missing required field: target' END,
 CASE WHEN entity = 'ghost' THEN 'unknown entity_id: ghost' END, CASE WHEN target = '[true, 1]' THEN 'target must be [row, column] integer coordinates' WHEN target IS NOT NULL AND (r >= 10 OR c >= 12) THEN 'target is outside configured bounds' WHEN target IS NOT NULL AND r = 2 AND c = 5 THEN 'target is blocked' END) END AS violations FROM a""")
def action_violations(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    op = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("click", "move", "view", "move", "purchase", "wait", "signup", "report"))), F.col("event_type")), F.lit("fly"))
    entity = F.when(e % 11 == 0, None).when(u % 7 == 0, "ghost").otherwise("robot")
    target = F.when(e % 13 == 0, None).when(e % 17 == 0, "[true, 1]").otherwise(F.concat(F.lit("["), (e % 12).cast("string"), F.lit(", "), (u % 14).cast("string"), F.lit("]")))
    said = F.to_json(F.struct(op.alias("operation"), entity.alias("entity_id"), target.alias("target")))
    fields = F.map_filter(F.from_json(said, "map<string,string>"), lambda k, v: v.isNotNull())
    rows = table(spark, sf, "events").select(e.alias("id"), fields.alias("fields"), F.array(F.lit("robot")).alias("entities"), F.array(F.lit("2,5")).alias("obstacles"))
    return actions.validated(rows, SPEC).select("id", F.array_join("violations", ";").alias("violations"))


MOVES_SQL = "(['N','NE','E','SE','S','SW','W','NW'])"
LOOP = f"""RECURSIVE m AS (SELECT user_id, list({MOVES_SQL}[CAST(event_id % 8 AS INT) + 1] ORDER BY ts, event_id) AS moves FROM events GROUP BY user_id),
 w AS (SELECT user_id, moves, 0 AS i, CAST(4 AS BIGINT) AS r, CAST(4 AS BIGINT) AS c, CAST(0 AS BIGINT) AS steps, 'open' AS status FROM m
 UNION ALL SELECT user_id, moves, i + 1, CASE WHEN bad IS NULL THEN nr ELSE r END, CASE WHEN bad IS NULL THEN nc ELSE c END, CASE WHEN bad IS NULL THEN steps + 1 ELSE steps END, coalesce(bad, CASE WHEN nr = 8 AND nc = 8 THEN 'goal' ELSE 'open' END)
 FROM (SELECT *, CASE WHEN nr < 0 OR nc < 0 OR nr >= 9 OR nc >= 9 THEN 'outside' WHEN nr = 6 AND nc = 6 THEN 'blocked' WHEN steps >= 100 THEN 'exceeded' END AS bad
 FROM (SELECT *, r + CASE WHEN contains(moves[i + 1], 'N') THEN -1 WHEN contains(moves[i + 1], 'S') THEN 1 ELSE 0 END AS nr, c + CASE WHEN contains(moves[i + 1], 'E') THEN 1 WHEN contains(moves[i + 1], 'W') THEN -1 ELSE 0 END AS nc FROM w WHERE status = 'open' AND i < len(moves)))),
 last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM w)"""


@query("closed_loops", f"WITH {LOOP} SELECT user_id, r AS row_at, c AS col_at, steps, status FROM last WHERE k = 1")
def closed_loops(spark, sf):
    """Each user's events, in time order, drive an agent from (4, 4) towards (8, 8)."""
    move = F.element_at(F.array(*map(F.lit, G.GRID_MOVES)), (F.col("event_id") % 8 + 1).cast("int"))
    m = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", move.alias("m")))).alias("s"))
    s = actions.walk(F.transform("s", lambda x: x["m"]), F.lit(4), F.lit(4), 9, F.array(F.lit("6,6")), F.lit(8), F.lit(8))
    return m.select("user_id", s.alias("w")).select("user_id", F.col("w.row").cast("long").alias("row_at"), F.col("w.col").cast("long").alias("col_at"), F.col("w.steps").cast("long").alias("steps"), "w.status")


@query("running_positions", """SELECT event_id, CAST(sum(CASE WHEN event_id % 8 IN (0, 1, 7) THEN -1 WHEN event_id % 8 IN (3, 4, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_at FROM events""")
def running_positions(spark, sf):
    """State after every move: a running sum inside each user's own sequence."""
    from pyspark.sql import Window

    k = F.col("event_id") % 8
    step = F.when(k.isin(0, 1, 7), -1).when(k.isin(3, 4, 5), 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", F.sum(step).over(w).alias("row_at"))


@query("grid_paths", "SELECT p_partkey AS id, CAST(greatest(abs(p_partkey % 7 - p_size % 7), abs(p_partkey % 5 - p_size % 6)) AS BIGINT) AS moves FROM part")
def grid_paths(spark, sf):
    """Search on empty 7x7 boards: the length must be the Chebyshev distance."""
    k, s = F.col("p_partkey"), F.col("p_size")
    path = grid_path(F.lit(7), (k % 7).cast("int"), (k % 5).cast("int"), (s % 7).cast("int"), (s % 6).cast("int"), F.array().cast("array<string>"))
    return table(spark, sf, "part").select(k.alias("id"), F.size(path).cast("long").alias("moves"))


N_TASKS = 200


def _draw(task: str, draw: str, lo: int, hi: int) -> str:
    return f"(('0x' || substr(md5('2026:{task}:' || id || ':' || {draw}), 1, 8))::BIGINT % {hi - lo + 1} + {lo})"


def _task_sql() -> str:
    d = _draw
    ids = f"ids AS (SELECT range AS id FROM range({N_TASKS}))"
    name = "'{t}-' || lpad(CAST(id + 1 AS VARCHAR), 7, '0')"
    parts = []
    t = "packing_shapes"
    w, h, bw, bh = d(t, "0", 1, 9), d(t, "1", 1, 9), d(t, "2", 3, 8), d(t, "3", 3, 8)
    parts.append(f"SELECT {name.format(t=t)} AS id, '{t}' AS task, CASE WHEN ({w} <= {bw} AND {h} <= {bh}) OR ({h} <= {bw} AND {w} <= {bh}) THEN 'YES' ELSE 'NO' END AS answer FROM ids")
    t = "mental_rotation"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', (['N','E','S','W'])[({d(t, '0', 1, 4)} - 1 + {d(t, '1', 1, 3)}) % 4 + 1] FROM ids")
    t = "double_point_relation"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', substr('ABCDEFGH', CAST((8 - {d(t, '0', 1, 7)}) % 8 + 1 AS BIGINT), 1) FROM ids")
    t = "door_rotation"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', CAST(({d(t, '0', 1, 10)} - {d(t, '1', 1, 9)} - 1 + 10) % 10 + 1 AS VARCHAR) FROM ids")
    t = "shortest_path"
    r0, c0, r1, c1 = (d(t, str(i), 0, 5) for i in range(4))
    parts.append(f"SELECT {name.format(t=t)}, '{t}', CAST(greatest(abs({r1} - {r0}), abs((CASE WHEN {r0} = {r1} AND {c0} = {c1} THEN ({c1} + 1) % 6 ELSE {c1} END) - {c0})) AS VARCHAR) FROM ids")
    for t in ("relative_direction", "object_location_distance"):
        ax, ay, bx, by = (d(t, str(i), -9, 9) for i in range(4))
        dx, dy = f"({bx} + CASE WHEN {ax} = {bx} AND {ay} = {by} THEN 1 ELSE 0 END - {ax})", f"({by} - {ay})"
        if t == "relative_direction":
            parts.append(f"SELECT {name.format(t=t)}, '{t}', CASE WHEN {dy} > 0 THEN 'N' WHEN {dy} < 0 THEN 'S' ELSE '' END || CASE WHEN {dx} > 0 THEN 'E' WHEN {dx} < 0 THEN 'W' ELSE '' END FROM ids")
        else:
            c = f"CAST(round(sqrt(CAST({dx} * {dx} + {dy} * {dy} AS DOUBLE)) * 100) AS BIGINT)"
            parts.append(f"SELECT {name.format(t=t)}, '{t}', ({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') FROM ids")
    moves = "list_transform(range(1, 5), lambda i: (['N','NE','E','SE','S','SW','W','NW'])[(('0x' || substr(md5('2026:{t}:' || id || ':' || (i + 10)), 1, 8))::BIGINT % 8 + 1)])"
    for t in ("door_rotation_multiturn", "spatial_relation_multiturn", "coordinates_movement_multiturn"):
        m = moves.format(t=t)
        dr = f"list_sum(list_transform({m}, lambda x: CASE WHEN contains(x, 'N') THEN -1 WHEN contains(x, 'S') THEN 1 ELSE 0 END))"
        dc = f"list_sum(list_transform({m}, lambda x: CASE WHEN contains(x, 'E') THEN 1 WHEN contains(x, 'W') THEN -1 ELSE 0 END))"
        parts.append(f"SELECT {name.format(t=t)}, '{t}', '(' || CAST({d(t, '0', 0, 4)} + {dr} AS BIGINT) || ', ' || CAST({d(t, '1', 0, 4)} + {dc} AS BIGINT) || ')' FROM ids")
    t = "memory_path"
    m = f"list_transform(range(1, {d(t, '2', 5, 10)} + 1), lambda i: (['N','S','E','W'])[(('0x' || substr(md5('2026:{t}:' || id || ':' || (i + 10)), 1, 8))::BIGINT % 4 + 1)])"
    along = lambda plus, less: f"list_sum(list_transform({m}, lambda x: CASE x WHEN '{plus}' THEN 1 WHEN '{less}' THEN -1 ELSE 0 END))"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', '(' || CAST({d(t, '0', -3, 3)} + {along('E', 'W')} AS BIGINT) || ', ' || CAST({d(t, '1', -3, 3)} + {along('N', 'S')} AS BIGINT) || ')' FROM ids")
    t = "multi_point_relation"
    step = lambda k: f"([-2, -1, 1, 2])[{d(t, str(k), 1, 4)}]"
    place = lambda xs: f"({xs})[{d(t, '0', 1, 4)}]"
    cx, cy = f"({place([2, -2, 1, -1])} + {step(1)})", f"({place([1, 1, -2, -2])} + {step(2)})"
    x = f"(CASE WHEN {cx} = 0 AND {cy} = 0 THEN 1 ELSE {cx} END)"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', CASE WHEN {cy} > 0 THEN 'N' WHEN {cy} < 0 THEN 'S' ELSE '' END || CASE WHEN {x} > 0 THEN 'E' WHEN {x} < 0 THEN 'W' ELSE '' END FROM ids")
    t = "mental_rotation_multiturn"
    parts.append(f"SELECT {name.format(t=t)}, '{t}', (['N','E','S','W'])[len(list_filter({moves.format(t=t)}, lambda x: x IN ('E', 'SE', 'NE'))) % 4 + 1] FROM ids")
    return f"WITH {ids} " + " UNION ALL ".join(parts)


CLOSED = ["packing_shapes", "mental_rotation", "double_point_relation", "door_rotation", "shortest_path", "relative_direction", "object_location_distance", "door_rotation_multiturn", "spatial_relation_multiturn", "coordinates_movement_multiturn", "mental_rotation_multiturn", "memory_path", "multi_point_relation"]


@query("synthetic_tasks", _task_sql())
def synthetic_tasks(spark, sf):
    return generators.all_tasks(spark, N_TASKS, CLOSED).select("id", "task", "answer")


@query("synthetic_searches")
def synthetic_searches(spark, sf):
    return generators.all_tasks(spark, N_TASKS, [t for t in generators.TIERS if t not in CLOSED])


@query("box_cases", "SELECT * FROM (VALUES ('Contains', 'Contains'), ('Within', 'Within'), ('Touches', 'Touches'), ('Intersects', 'Intersects'), ('Disjoint', 'Disjoint')) v(declared, answer)")
def box_cases(spark, sf):
    return generators.box_cases(spark, 3).select("declared", "answer")


@query("named_pairs", """SELECT s_suppkey AS id, a AS anonymous, CASE WHEN a THEN 'Object A' ELSE s_name END AS name, CASE WHEN a THEN 'Object B' ELSE n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (true), (false)) v(a)""")
def named_pairs(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("place"))
    return generators.named_and_anonymous(rows, {"name": "Object A", "place": "Object B"}).select("id", "anonymous", "name", "place")


@query("loss_masks", """SELECT conv_id, turn, CAST(length(role) AS BIGINT) AS ignored, CAST(length(role) + length(text) + 1 AS BIGINT) AS tokens FROM conversations WHERE length(text) > 0""")
def loss_masks(spark, sf):
    """Characters stand for tokens: the role is the prompt, the text the answer."""
    ids = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    rows = table(spark, sf, "conversations").filter(F.length("text") > 0)
    m = masks.loss_mask(ids(F.col("role")), F.concat(ids(F.col("role")), ids(F.col("text"))), 0, 1 << 24)
    got = rows.select("conv_id", "turn", m.alias("m"))
    return got.select("conv_id", "turn", F.size(F.filter("m.labels", lambda x: x == masks.IGNORED)).cast("long").alias("ignored"), F.size("m.input_ids").cast("long").alias("tokens"))
