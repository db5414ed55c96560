"""Rendered text and planted completions: render, parse, round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import graph
from . import network as net
from .points import BEARING, PAIRS, pairs
from .registry import query, table

WORD_SQL = "CASE direction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.WORDS.items()) + " END"
RIGHT = "'{\"direction\":\"' || direction || '\"}'"
WRONG = "'{\"direction\":\"' || CASE WHEN direction = 'N' THEN 'S' ELSE 'N' END || '\"}'"
OBS, ORI, TAIL = "Observe: p1 and p2 share one coordinate system.", "Orient: classify the displacement.", "\nThat is all."
DEC = f"'Decide: p2 is ' || {WORD_SQL} || ' of p1.'"
NL = "chr(10)"
FULL = f"'{OBS}' || {NL} || '{ORI}' || {NL} || {DEC} || {NL} || 'Act: ' || "
KINDS = 9
COMPLETIONS = f"""{PAIRS}, named AS (SELECT a_id, dx, dy, {BEARING} AS direction FROM pairs), completions AS (SELECT a_id, direction, dx, dy, 'demo-location_direction-' || lpad(CAST(a_id AS VARCHAR), 6, '0') AS scenario_id, CASE a_id % {KINDS}
 WHEN 0 THEN {FULL}{RIGHT} WHEN 1 THEN {FULL}{WRONG} WHEN 2 THEN '{OBS}' || {NL} || {DEC} || {NL} || 'Act: ' || {RIGHT}
 WHEN 3 THEN {FULL}{RIGHT} || {NL} || 'That is all.' WHEN 4 THEN direction
 WHEN 5 THEN '{ORI}' || {NL} || '{OBS}' || {NL} || {DEC} || {NL} || 'Act: the answer is ' || direction || '.'
 WHEN 6 THEN {FULL}{WRONG} || {NL} || 'Act: ' || {RIGHT}
 WHEN 7 THEN {FULL}'Output ' || direction ELSE lower({FULL}direction) || '!' END AS completion FROM named)"""


def completions(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf).withColumn("direction", G.bearing8(F.col("dx"), F.col("dy")))
    d = F.col("direction")
    obj = lambda v: F.concat(F.lit('{"direction":"'), v, F.lit('"}'))
    right, wrong = obj(d), obj(F.when(d == "N", "S").otherwise("N"))
    dec = F.concat(F.lit("Decide: p2 is "), G.compass_word(d), F.lit(" of p1."))
    line = lambda *parts: F.concat_ws("\n", *parts)
    o, r = F.lit(OBS), F.lit(ORI)
    full = lambda act: line(o, r, dec, F.concat(F.lit("Act: "), act))
    k = F.col("a_id") % KINDS
    text = (F.when(k == 0, full(right)).when(k == 1, full(wrong)).when(k == 2, line(o, dec, F.concat(F.lit("Act: "), right))).when(k == 3, F.concat(full(right), F.lit(TAIL))).when(k == 4, d)
            .when(k == 5, line(r, o, dec, F.concat(F.lit("Act: the answer is "), d, F.lit(".")))).when(k == 6, line(full(wrong), F.concat(F.lit("Act: "), right))).when(k == 7, full(F.concat(F.lit("Output "), d))).otherwise(F.concat(F.lower(full(d)), F.lit("!"))))
    return p.select("a_id", "direction", "dx", "dy", F.concat(F.lit("demo-location_direction-"), F.lpad(F.col("a_id").cast("string"), 6, "0")).alias("scenario_id"), text.alias("completion"))


EXTRACT = r"""rtrim(CASE WHEN regexp_extract(completion, '(?im)^\s*act\s*:\s*(?:output\s+)?(.+?)\s*$', 1) <> '' THEN trim(regexp_replace(regexp_extract(completion, '(?im)^\s*act\s*:\s*(?:output\s+)?(.+?)\s*$', 1), '(?i)^the answer is\s+', ''))
 ELSE trim(string_split(regexp_replace(completion, '^\s+|\s+$', '', 'g'), chr(10))[-1]) END, '.')"""
# Case folding beyond lower case, for the letters of the tables' languages.
_FOLDED = r"replace(replace(replace(lower({c}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')"
NORMAL = r"""trim(regexp_replace(""" + _FOLDED.replace("{c}", r"regexp_replace({c}, '^\s+|\s+$', '', 'g')") + r""", '\s+', ' ', 'g'), ' .,!"''')"""
REST = r"CASE WHEN len(string_split_regex(completion, '(?im)^Act:\s*')) > 1 THEN string_split_regex(completion, '(?im)^Act:\s*')[-1] END"
ACTS = f"""{COMPLETIONS}, rests AS (SELECT *, {REST} AS rest FROM completions), objs AS (SELECT *, regexp_extract(rest, '^(\\{{[^{{}}]*\\}})', 1) AS obj FROM rests),
 acts AS (SELECT *, CASE WHEN obj <> '' THEN obj END AS json, coalesce(obj <> '' AND trim(substr(rest, length(obj) + 1), ' ' || chr(10)) = '', false) AS is_final,
 CASE WHEN rest IS NULL THEN 'missing Act heading' WHEN obj = '' THEN 'invalid Act JSON' WHEN trim(substr(rest, length(obj) + 1), ' ' || chr(10)) <> '' THEN 'non-whitespace text follows Act JSON' END AS error FROM objs)"""


@query("extract_answers", f"WITH {COMPLETIONS} SELECT a_id, {EXTRACT} AS answer FROM completions")
def extract_answers(spark, sf):
    return completions(spark, sf).select("a_id", X.extract_answer(F.col("completion")).alias("answer"))


@query("final_acts", f"WITH {ACTS} SELECT a_id, json, error, is_final FROM acts")
def final_acts(spark, sf):
    return completions(spark, sf).select("a_id", X.final_act(F.col("completion")).alias("f")).select("a_id", "f.json", "f.error", "f.is_final")


@query("final_acts_nested", f"WITH {ACTS} SELECT a_id, json, error, is_final FROM acts")
def final_acts_nested(spark, sf):
    return completions(spark, sf).select("a_id", X.final_act_nested(X.act_remainder(F.col("completion"))).alias("f")).select("a_id", "f.json", "f.error", "f.is_final")


def _at(h: str) -> str:
    return f"length(string_split_regex(completion, '(?im)^{h}:\\s*')[1])"


ONCE = " AND ".join(f"len(string_split_regex(completion, '(?im)^{h}:\\s*')) = 2" for h in X.STAGES)
ORDER = " AND ".join(f"{_at(a)} < {_at(b)}" for a, b in zip(X.STAGES, X.STAGES[1:]))


@query("stage_schema", f"WITH {ACTS} SELECT a_id, {ONCE} AND {ORDER} AND is_final AS valid FROM acts")
def stage_schema(spark, sf):
    return completions(spark, sf).select("a_id", X.stages_in_order(F.col("completion")).alias("valid"))


@query("normalized_turns", f"SELECT conv_id, turn, {NORMAL.format(c='text')} AS answer FROM conversations")
def normalized_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("answer"))


@query("tasks_from_ids", f"""WITH ids AS (SELECT event_id, 'demo-' || CASE event_id % 6 WHEN 0 THEN 'location_direction' WHEN 1 THEN 'location_distance' WHEN 2 THEN 'object_topology' WHEN 3 THEN 'network_connectivity' WHEN 4 THEN 'network_shortest_path' ELSE 'other' END || '-' || event_id AS scenario_id FROM events)
 SELECT scenario_id, CASE WHEN contains(scenario_id, '-location_direction-') THEN 'location_direction' WHEN contains(scenario_id, '-location_distance-') THEN 'location_distance' WHEN contains(scenario_id, '-object_topology-') THEN 'object_topology' WHEN contains(scenario_id, '-network_connectivity-') THEN 'network_connectivity' WHEN contains(scenario_id, '-network_shortest_path-') THEN 'network_shortest_path' END AS task FROM ids""")
def tasks_from_ids(spark, sf):
    e = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(t) for t in (*X.TASKS, "other")]), (e % 6 + 1).cast("int"))
    ids = table(spark, sf, "events").select(F.concat_ws("-", F.lit("demo"), name, e.cast("string")).alias("scenario_id"))
    return ids.select("scenario_id", X.task_of(F.col("scenario_id")).alias("task"))


M = "printf('%.3f', {})"
SCENE = f"'Task: relative direction' || {NL} || {NL} || 'Spatial data (projected coordinates; unit: m):' || {NL} || 'p1: (' || {M.format('ax')} || ', ' || {M.format('ay')} || ')' || {NL} || 'p2: (' || {M.format('bx')} || ', ' || {M.format('b_y')} || ')'"


@query("point_messages", f"WITH {PAIRS} SELECT a_id, 'Question:' || {NL} || {SCENE} || {NL} || {NL} || 'Query: What is the 8-way direction of p2 relative to p1?' AS message FROM pairs")
def point_messages(spark, sf):
    scene = X.point_scene("direction", *[F.col(c) for c in ("ax", "ay", "bx", "by")])
    return pairs(spark, sf).select("a_id", X.user_message(scene, X.question("direction")).alias("message"))


@query("point_traces", f"""WITH {PAIRS}, r AS (SELECT a_id, round(dx, 3) AS rx, round(dy, 3) AS ry, {BEARING} AS direction FROM pairs) SELECT a_id, 'Observe: p1 and p2 are given in the same projected coordinate system.' || {NL} || 'Orient: Compute the target-minus-reference displacement and classify its bearing into one of eight directions.' || {NL} || 'Decide: Δx = ' || {M.format('rx')} || ' m and Δy = ' || {M.format('ry')} || ' m, so p2 is ' || {WORD_SQL} || ' of p1.' || {NL} || 'Act: ' || {RIGHT} AS trace FROM r""")
def point_traces(spark, sf):
    p = pairs(spark, sf).withColumn("direction", G.bearing8(F.col("dx"), F.col("dy")))
    x, y = F.round("dx", 3), F.round("dy", 3)
    out = X.trace(F.lit("p1 and p2 are given in the same projected coordinate system."), F.lit("Compute the target-minus-reference displacement and classify its bearing into one of eight directions."),
                  X.direction_decision(x, y, F.col("direction")), F.concat(F.lit('{"direction":"'), F.col("direction"), F.lit('"}')))
    return p.select("a_id", out.alias("trace"))


STYLES = "(VALUES ('qa'), ('minimal'), ('ooda')) AS s(style)"


@query("three_views", f"""WITH {COMPLETIONS} SELECT scenario_id || '-' || style AS example_id, style, CASE style WHEN 'qa' THEN direction WHEN 'minimal' THEN {DEC} || {NL} || 'Answer: ' || direction ELSE completion END AS content FROM completions, {STYLES}""")
def three_views(spark, sf):
    c = completions(spark, sf).withColumn("style", F.explode(F.array(*map(F.lit, ("qa", "minimal", "ooda")))))
    dec = F.concat(F.lit("Decide: p2 is "), G.compass_word(F.col("direction")), F.lit(" of p1."))
    return c.select(F.concat_ws("-", "scenario_id", "style").alias("example_id"), "style", X.completion(F.col("style"), F.col("direction"), dec, F.col("completion")).alias("content"))


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a path query: nodes, edges and rendered text of its scene."""
    n = net.network(spark, sf)
    q = graph.choose_queries(graph.best_paths(n, 2)).withColumn("scene", F.concat_ws("-", "src", "dst"))
    members = q.select("scene", F.explode(F.array_union("path", "runner_up_path")).alias("node"), F.col("src").alias("source"), F.col("dst").alias("target"))
    names = graph.aliases(members)
    edges = graph.induced(n, members.select("scene", "node"))
    a, b = names.toDF("scene", "src", "a"), names.toDF("scene", "dst", "b")
    shown = edges.join(a, ["scene", "src"]).join(b, ["scene", "dst"]).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("a", "b", (F.col("cost") / 100.0).alias("cost_m")))).alias("edges"))
    nodes = names.groupBy("scene").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("alias", 2, 9).cast("int").alias("k"), "alias"))), lambda x: x["alias"]).alias("nodes"))
    text = X.network_scene("shortest_path", F.col("nodes"), F.col("edges"), F.lit("n1"), F.lit("n2"))
    return q.join(shown, "scene").join(nodes, "scene").withColumn("text", text)


ALIASED = net.CHOSEN + """, mem AS MATERIALIZED (SELECT DISTINCT src || '-' || dst AS scene, src, dst, unnest(list_distinct(list_concat(path, path2))) AS node FROM chosen),
 nam AS MATERIALIZED (SELECT scene, node, row_number() OVER (PARTITION BY scene ORDER BY (node = src) DESC, (node = dst) DESC, node) AS k FROM mem),
 shown AS MATERIALIZED (SELECT x.scene, 'n' || x.k AS a, 'n' || y.k AS b, e.cost / 100.0 AS cost_m FROM net e JOIN nam x ON x.node = e.src JOIN nam y ON y.scene = x.scene AND y.node = e.dst)"""


@query("network_messages", f"""WITH RECURSIVE {ALIASED}, el AS (SELECT scene, string_agg(a || ' -> ' || b || ', cost=' || {M.format('cost_m')} || ' m', {NL} ORDER BY a, b) AS el FROM shown GROUP BY scene), nl AS (SELECT scene, string_agg('n' || k, ', ' ORDER BY k) AS nl FROM nam GROUP BY scene)
 SELECT scene, 'Task: directed-network shortest path' || {NL} || {NL} || 'Nodes: ' || nl || {NL} || 'Directed edges:' || {NL} || el || {NL} || 'Query source: n1' || {NL} || 'Query target: n2' AS text FROM el JOIN nl USING (scene)""")
def network_messages(spark, sf):
    return scenes(spark, sf).select("scene", "text")


@query("parsed_edges", f"WITH RECURSIVE {ALIASED} SELECT scene, a, b, CAST(round(cost_m * 100) AS BIGINT) AS cents, 'n1' AS source, 'n2' AS target FROM shown")
def parsed_edges(spark, sf):
    """Round trip: what the rendered text says, read back."""
    t = F.col("text")
    rows = scenes(spark, sf).select("scene", F.explode(X.parse_edges(t)).alias("e"), X.parse_query(t, "source").alias("source"), X.parse_query(t, "target").alias("target"))
    return rows.select("scene", "e.a", "e.b", F.round(F.col("e.cost") * 100).cast("long").alias("cents"), "source", "target")


@query("anonymous_names", "SELECT CAST(r.r_regionkey AS BIGINT) AS region, n_name AS name, 'Node ' || row_number() OVER (PARTITION BY r.r_regionkey ORDER BY n.n_nationkey) AS alias FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def anonymous_names(spark, sf):
    n = table(spark, sf, "nation")
    names = graph.anonymous_nodes(n.select(F.col("n_regionkey").alias("scene"), F.col("n_nationkey").alias("node")))
    return names.join(n, names["node"] == n["n_nationkey"]).select(F.col("scene").cast("long").alias("region"), F.col("n_name").alias("name"), "alias")


@query("language_guards", r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' p2 lies to the S of p1' WHEN 1 THEN ' at a total distance and cost' WHEN 2 THEN ' n3 cannot be reached' ELSE '' END AS t FROM documents)
 SELECT doc_id, regexp_matches(lower(t), '\bto\s+the\s+(?:n|ne|e|se|s|sw|w|nw)\s+of\b') AS symbolic, contains(lower(t), 'total length') OR contains(lower(t), 'total distance') OR contains(lower(t), 'travel time') OR contains(lower(t), 'total time') OR NOT contains(lower(t), 'cost') AS relabelled,
 regexp_matches(lower(t), '\b(?:no\s+(?:(?:legal|valid|directed)\s+)*(?:path|route|connection|sequence)|cannot\s+(?:be\s+)?reach(?:ed)?|(?:is|are)\s+unreachable|(?:is|are)\s+not\s+reachable|does\s+not\s+lead\s+to|never\s+(?:arrives?|leads?|yields?))\b') AS unreachable FROM t""")
def language_guards(spark, sf):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " p2 lies to the S of p1").when(k == 1, " at a total distance and cost").when(k == 2, " n3 cannot be reached").otherwise("")
    t = table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return t.select("doc_id", X.symbolic_compass(F.col("t")).alias("symbolic"), X.relabels_cost(F.col("t")).alias("relabelled"), X.says_unreachable(F.col("t")).alias("unreachable"))
