"""Gold answers recomputed from stored scenes, records against their contract, predicted paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import verify as V
from ..operators import graph, scoring
from . import network as net
from .points import BEARING, PAIRS, pairs
from .registry import query
from .text import M, NL, SCENE, WORD_SQL, scenes


@query("gold_recheck", f"""WITH {PAIRS}, g AS (SELECT a_id, {BEARING} AS direction, round(sqrt(dx * dx + dy * dy), 3) AS d FROM pairs)
 SELECT a_id, NOT (a_id % 5 = 0) AS direction_ok, NOT (a_id % 7 = 0) AS distance_ok, NOT (a_id % 5 = 0) AND NOT (a_id % 7 = 0) AS ok FROM g WHERE direction IS NOT NULL""")
def gold_recheck(spark, sf):
    """Planted wrong golds must be found, right ones kept: the scene alone decides."""
    p = pairs(spark, sf)
    truth, far = G.bearing8(F.col("dx"), F.col("dy")), G.distance(F.col("dx"), F.col("dy"))
    gold = F.when(F.col("a_id") % 5 == 0, F.when(truth == "N", "S").otherwise("N")).otherwise(truth)
    metres = F.when(F.col("a_id") % 7 == 0, far + 1).otherwise(far)
    rows = p.select("a_id", gold.alias("gold"), metres.alias("metres"), truth.alias("truth"), far.alias("far")).filter("truth is not null")
    return rows.select("a_id", (F.col("gold") == F.col("truth")).alias("direction_ok"), X.same_number(F.col("metres"), F.col("far"), 0.0).alias("distance_ok"), ((F.col("gold") == F.col("truth")) & X.same_number(F.col("metres"), F.col("far"), 0.0)).alias("ok"))


RECORD = f"""WITH {PAIRS}, r AS (SELECT a_id, a_id % 6 AS k, ax, ay, bx, b_y, round(dx, 3) AS rx, round(dy, 3) AS ry, {BEARING} AS direction FROM pairs), s AS (SELECT *, {SCENE} AS scene FROM r),
 m AS (SELECT *, 'Question:' || {NL} || CASE WHEN k = 1 THEN replace(scene, 'p1', 'p9') ELSE scene END || {NL} || {NL} || 'Query: ' || CASE WHEN k = 2 THEN ' ' ELSE 'Where is p2?' END AS message,
 'Decide: Δx = ' || {M.format('rx')} || ' m' || CASE WHEN k = 3 THEN '' ELSE ' and Δy = ' || {M.format('ry')} || ' m' END || ', so p2 is ' || CASE WHEN k = 4 THEN 'there' ELSE {WORD_SQL} END || '.' || {NL} || {NL} || 'Act:' || {NL} || 'x' AS trace FROM s)"""


@query("record_violations", f"""{RECORD} SELECT a_id, concat_ws(',', CASE WHEN NOT (starts_with(message, 'Question:' || {NL} || scene || {NL} || {NL} || 'Query: ') AND trim(substr(message, length('Question:' || {NL} || scene || {NL} || {NL} || 'Query: ') + 1)) <> '') THEN 'scene text' END,
 CASE WHEN NOT (contains(message, 'p1: (' || {M.format('ax')} || ', ' || {M.format('ay')} || ')') AND contains(message, 'p2: (' || {M.format('bx')} || ', ' || {M.format('b_y')} || ')')) THEN 'scene facts' END,
 CASE WHEN NOT (contains(trace, 'Δx') AND contains(trace, {M.format('rx')}) AND contains(trace, 'Δy') AND contains(trace, {M.format('ry')}) AND contains(trace, {WORD_SQL})) THEN 'evidence' END) AS problems FROM m""")
def record_violations(spark, sf):
    """Fixed scene, complete facts, evidence before the act: reasons in order."""
    k, c = F.col("a_id") % 6, F.col
    p = pairs(spark, sf).withColumn("direction", G.bearing8(c("dx"), c("dy")))
    scene = X.point_scene("direction", c("ax"), c("ay"), c("bx"), c("by"))
    x, y = X.metres(F.round("dx", 3)), X.metres(F.round("dy", 3))
    word = G.compass_word(c("direction"))
    shown = F.when(k == 1, F.replace(scene, F.lit("p1"), F.lit("p9"))).otherwise(scene)
    message = F.concat(F.lit("Question:\n"), shown, F.lit("\n\nQuery: "), F.when(k == 2, " ").otherwise("Where is p2?"))
    trace = F.concat(F.lit("Decide: Δx = "), x, F.lit(" m"), F.when(k == 3, "").otherwise(F.concat(F.lit(" and Δy = "), y, F.lit(" m"))), F.lit(", so p2 is "), F.when(k == 4, "there").otherwise(word), F.lit(".\n\nAct:\nx"))
    point = lambda n, a, b: F.concat(F.lit(f"p{n}: ("), X.metres(a), F.lit(", "), X.metres(b), F.lit(")"))
    checks = [(V.scene_kept(message, scene), "scene text"), (V.facts_present(message, F.array(point(1, c("ax"), c("ay")), point(2, c("bx"), c("by")))), "scene facts"),
              (V.evidence(F.lit("ooda"), trace, F.array(F.lit("Δx"), x, F.lit("Δy"), y, word)), "evidence")]
    return p.select("a_id", F.array_join(scoring.violations(checks), ",").alias("problems"))


@query("network_gold_recheck", f"WITH RECURSIVE {net.CHOSEN} SELECT src || '-' || dst AS scene, NOT (src % 4 = 0) AS ok FROM chosen")
def network_gold_recheck(spark, sf):
    """The rendered text alone: edges are read back, the gold cost must be that of a shortest path of any length."""
    s = scenes(spark, sf).select("scene", "text", F.when(F.col("src") % 4 == 0, F.col("cost") + 1).otherwise(F.col("cost")).alias("gold"))
    name = lambda n: F.concat_ws(":", "scene", n)
    edges = s.select("scene", F.explode(X.parse_edges(F.col("text"))).alias("e")).select(name(F.col("e.a")).alias("src"), name(F.col("e.b")).alias("dst"), F.round(F.col("e.cost") * 100).cast("long").alias("cost"))
    best = graph.shortest_costs(edges).withColumnRenamed("cost", "best")
    ends = s.select("scene", "gold", name(X.parse_query(F.col("text"), "source")).alias("src"), name(X.parse_query(F.col("text"), "target")).alias("dst"))
    return ends.join(best, ["src", "dst"], "left").select("scene", F.coalesce(F.col("best") == F.col("gold"), F.lit(False)).alias("ok"))


@query("path_scores", f"""WITH RECURSIVE {net.CHOSEN}, pred AS (SELECT src || '-' || dst AS scene, src, dst, cost, CASE (src + dst) % 3 WHEN 0 THEN path WHEN 1 THEN path2 ELSE list_reverse(path) END AS p FROM chosen), legs AS (SELECT scene, unnest(p[1:len(p) - 1]) AS a, unnest(p[2:len(p)]) AS b FROM pred),
 sums AS (SELECT scene, count(*) = count(e.cost) AS whole, sum(e.cost) AS total FROM legs LEFT JOIN net e ON e.src = a AND e.dst = b GROUP BY scene)
 SELECT scene, whole AND p[1] = src AND p[len(p)] = dst AS path_is_legal, whole AND p[1] = src AND p[len(p)] = dst AND total = cost AS reported_cost_matches, whole AND p[1] = src AND p[len(p)] = dst AND total = cost AS path_is_optimal FROM pred JOIN sums USING (scene)""")
def path_scores(spark, sf):
    """Predicted paths (best, second, reversed) that all report the best cost."""
    n = net.network(spark, sf)
    q = graph.choose_queries(graph.best_paths(n, 2))
    k = (F.col("src") + F.col("dst")) % 3
    pred = q.select(F.concat_ws("-", "src", "dst").alias("scene"), "src", "dst", F.col("cost").alias("reported"), F.when(k == 0, F.col("path")).when(k == 1, F.col("runner_up_path")).otherwise(F.reverse("path")).alias("path"))
    got = graph.check_paths(pred, n, ["scene"]).join(pred, "scene")
    legal = F.col("legal") & (F.element_at("path", 1) == F.col("src")) & (F.element_at("path", -1) == F.col("dst"))
    same = legal & (F.col("cost") == F.col("reported"))
    return got.select("scene", legal.alias("path_is_legal"), F.coalesce(same, F.lit(False)).alias("reported_cost_matches"), F.coalesce(same, F.lit(False)).alias("path_is_optimal"))
