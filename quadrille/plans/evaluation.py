"""Evaluation reports, candidate groups, local scenes, pools and atomic examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from . import network as net
from . import scores
from .points import BOXES, PAIRS, POINTS, SIGN, boxes, pairs, points
from .registry import query, table
from .text import completions

_RATE = "CAST(round(avg(CAST(coalesce({f}, false) AS INT)), 6) AS VARCHAR)"
_RATES = " || ',' || ".join(f"'\"{f}\":' || {_RATE.format(f=f)}" for f in scores.FLAGS)


@query("evaluation_report", f"""WITH {scores.SCORED}, bad AS (SELECT a_id FROM scored WHERE NOT coalesce(act_exact, false) ORDER BY a_id LIMIT 1000)
 SELECT count(*) AS records, CAST(count(*) FILTER (NOT coalesce(act_exact, false)) AS BIGINT) AS errors, '{{' || {_RATES} || '}}' AS rates, (SELECT string_agg(a_id, ',' ORDER BY a_id) FROM bad) AS error_ids FROM scored""")
def evaluation_report(spark, sf):
    out = E.report(scores.scored(spark, sf), scores.FLAGS, key="a_id")
    return out.withColumn("error_ids", F.array_join("error_ids", ","))


@query("prediction_errors", f"WITH {scores.SCORED} SELECT a_id, task, error FROM scored WHERE NOT coalesce(act_exact, false)")
def prediction_errors(spark, sf):
    return E.errors(scores.scored(spark, sf)).select("a_id", "task", "error")


@query("oracle_predictions", f"""WITH {PAIRS}, q AS (SELECT a_id, 'Which way is ' || (b_id % 50) || ' from ' || (a_id % 50) || '?' AS question, {SIGN} AS answer FROM pairs), known AS (SELECT question, min(answer) AS prediction FROM q GROUP BY question HAVING count(DISTINCT answer) = 1)
 SELECT a_id, question, prediction, coalesce(prediction = answer, false) AS correct FROM q LEFT JOIN known USING (question)""")
def oracle_predictions(spark, sf):
    """Questions asked again in other scenes: the gold where it is one answer, null where answers differ."""
    from ..functions import geometry as G

    p = pairs(spark, sf)
    q = p.select("a_id", F.concat(F.lit("Which way is "), (F.col("b_id") % 50).cast("string"), F.lit(" from "), (F.col("a_id") % 50).cast("string"), F.lit("?")).alias("question"), G.sign_direction(F.col("dx"), F.col("dy")).alias("answer"))
    return E.oracle_predictor(q, q.select("question", "answer")).select("a_id", "question", "prediction", F.coalesce(F.col("prediction") == F.col("answer"), F.lit(False)).alias("correct"))


@query("candidate_scores", f"""WITH {scores.REWARDS}, g AS (SELECT *, a_id // 4 AS grp, first_value(direction) OVER (PARTITION BY a_id // 4 ORDER BY a_id) AS expected FROM rewards),
 s AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY a_id) - 1 AS position, CASE WHEN conclusion = -1.4 THEN -1.4 WHEN {scores.NORMAL.format(c='answer')} = lower(expected) THEN 1.0 ELSE -1.0 END + format AS reward FROM g)
 SELECT grp, CAST(position AS BIGINT) AS position, CAST(round(reward * 10) AS BIGINT) AS tenths, CAST(round((reward - avg(reward) OVER (PARTITION BY grp)) / (stddev_pop(reward) OVER (PARTITION BY grp) + 0.000001) * 1000) AS BIGINT) AS advantage FROM s""")
def candidate_scores(spark, sf):
    """Four completions a group, all against the truth of the first."""
    c = completions(spark, sf).select(F.floor(F.col("a_id") / 4).cast("long").alias("grp"), F.struct("a_id", "completion", "direction").alias("c"))
    groups = c.groupBy("grp").agg(F.array_sort(F.collect_list("c")).alias("c")).select("grp", F.col("c.completion").alias("candidates"), F.get("c.direction", 0).alias("expected"))
    out = E.score_candidates(groups, "grp")
    return out.select("grp", F.col("position").cast("long"), F.round(F.col("reward") * 10).cast("long").alias("tenths"), F.round(F.col("advantage") * 1000).cast("long").alias("advantage"))


@query("local_scenes", f"""WITH RECURSIVE {net.NET}, both_ways AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), walk AS (SELECT n_nationkey AS seed, n_nationkey AS node, 0 AS h FROM nation UNION SELECT w.seed, e.dst, w.h + 1 FROM walk w JOIN both_ways e ON w.node = e.src WHERE w.h < 3),
 near AS (SELECT DISTINCT seed, node FROM walk), kept AS (SELECT *, count(*) OVER (PARTITION BY seed) AS near, row_number() OVER (PARTITION BY seed ORDER BY (node = seed) DESC, md5('0:' || seed || ':' || node)) AS turn FROM near),
 mem AS (SELECT seed, node FROM kept WHERE near >= {E.NEAR} AND turn <= {E.KEPT}), inside AS (SELECT a.seed, count(*) AS edges FROM net e JOIN mem a ON a.node = e.src JOIN mem b ON b.seed = a.seed AND b.node = e.dst GROUP BY a.seed)
 SELECT CAST(i.seed AS BIGINT) AS scene, CAST(any_value(i.edges) AS BIGINT) AS edges, count(*) AS nodes FROM inside i JOIN mem USING (seed) WHERE i.edges BETWEEN {E.FEWEST} AND {E.MOST} GROUP BY i.seed""")
def local_scenes(spark, sf):
    seeds = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    nodes, edges = E.local_scenes(net.network(spark, sf), seeds)
    return edges.groupBy("scene").agg(F.count("*").alias("edges")).join(nodes.groupBy("scene").agg(F.count("*").alias("nodes")), "scene").select(F.col("scene").cast("long"), "edges", "nodes")


@query("location_pool", f"WITH {POINTS}, {BOXES} SELECT 'poi' AS kind, vec_id AS id, x, y FROM points UNION ALL SELECT 'aoi', id, (x1 + x2) / 2.0, (y1 + y2) / 2.0 FROM boxes")
def location_pool(spark, sf):
    anchors = boxes(spark, sf).select("id", ((F.col("x1") + F.col("x2")) / 2.0).alias("x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("y"))
    return E.location_pool(points(spark, sf).withColumnRenamed("vec_id", "id"), anchors)


def _draw(k: int, lo: int, hi: int) -> str:
    return f"(('0x' || substr(md5('2026:direction:' || id || ':{k}'), 1, 8))::BIGINT % {hi - lo + 1} + {lo})"


_DRAWN = f"""raw AS (SELECT range AS id FROM range(300)), p AS (SELECT id, {_draw(0, -20, 20)} AS ax, {_draw(1, -20, 20)} AS ay, {_draw(2, -20, 20)} AS x, {_draw(3, -20, 20)} AS b_y, {_draw(4, 0, 1)} AS form FROM raw),
 drawn AS (SELECT *, x + CASE WHEN ax = x AND ay = b_y THEN 1 ELSE 0 END AS bx FROM p), d AS (SELECT *, bx - ax AS dx, b_y - ay AS dy, 'Object A at (' || ax || ', ' || ay || ')' AS a, 'Object B at (' || bx || ', ' || b_y || ')' AS b FROM drawn)"""
_ID = "lpad(CAST(id + 1 AS VARCHAR), 7, '0')"


@query("direction_examples", f"""WITH {_DRAWN} SELECT 'direction-' || {_ID} AS id, CASE form WHEN 0 THEN 'What is the direction of ' || b || ' relative to ' || a || '?' ELSE 'Which direction from ' || a || ' leads to ' || b || '?' END AS question, {SIGN} AS answer, 'synthetic,in_domain' AS tags FROM d
 UNION ALL SELECT 'direction-' || {_ID}, b || ' lies on which side of ' || a || '?', {SIGN}, 'synthetic,linguistic_ood' FROM d""")
def direction_examples(spark, sf):
    both = E.direction_examples(spark, 300).unionByName(E.direction_examples(spark, 300, unusual=True))
    return both.withColumn("tags", F.array_join("tags", ","))


_POINT = "printf('(%.3f, %.3f)', {x}, {y})"


@query("map_directions", f"""WITH {PAIRS}, n AS (SELECT *, CASE WHEN a_id % 3 = 0 THEN 'Object A' ELSE 'Place ' || a_id END AS an, 'Place ' || b_id AS bn, {SIGN} AS answer, ' at ' || {_POINT.format(x='ax', y='ay')} AS pa, ' at ' || {_POINT.format(x='bx', y='b_y')} AS pb FROM pairs)
 SELECT a_id, false AS anonymous, 'What is the direction of ' || bn || pb || ' relative to ' || an || pa || '?' AS question, answer FROM n WHERE answer IS NOT NULL
 UNION ALL SELECT a_id, true, 'What is the direction of Object B' || pb || ' relative to Object A' || pa || '?', answer FROM n WHERE answer IS NOT NULL""")
def map_directions(spark, sf):
    """Named (a blank name gets its stand-in) and anonymous."""
    named = pairs(spark, sf).withColumnRenamed("b_y", "by").withColumns({"a_name": F.when(F.col("a_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Place "), F.col("a_id"))), "b_name": F.concat(F.lit("Place "), F.col("b_id"))})
    both = [E.map_directions(named, stand).withColumn("anonymous", F.lit(stand)) for stand in (False, True)]
    return both[0].unionByName(both[1])


@query("atomic_examples", f"""WITH {_DRAWN} SELECT 'direction-' || {_ID} AS id, 'direction' AS concept, {SIGN} AS answer FROM d
 UNION ALL SELECT 'topology-' || {_ID}, 'topology', (['Contains','Within','Touches','Intersects','Disjoint'])[id % 5 + 1] FROM raw UNION ALL SELECT 'connectivity-' || {_ID}, 'connectivity', (['Connected','Disconnected'])[id % 2 + 1] FROM raw""")
def atomic_examples(spark, sf):
    return E.atomic_examples(spark, 300)


@query("aliased_examples", f"""WITH {PAIRS} SELECT a_id, question, answer, question AS input, answer AS output FROM (SELECT a_id, 'From ' || a_id || ' to ' || b_id || '?' AS question, {SIGN} AS answer FROM pairs)""")
def aliased_examples(spark, sf):
    from ..functions import geometry as G

    e = pairs(spark, sf).select("a_id", F.concat(F.lit("From "), F.col("a_id"), F.lit(" to "), F.col("b_id"), F.lit("?")).alias("question"), G.sign_direction(F.col("dx"), F.col("dy")).alias("answer"))
    return E.with_aliases(e, input="question", output="answer")


@query("flat_token_ids", "SELECT conv_id, turn, CAST(2 * length(text) + turn AS BIGINT) AS total FROM conversations")
def flat_token_ids(spark, sf):
    """A struct of nested ids, as tokenizers return them, becomes one flat list."""
    t = table(spark, sf, "conversations")
    made = t.withColumn("made", F.struct(F.array(F.array(F.length("text"), F.col("turn").cast("int")), F.array(F.length("text"))).alias("input_ids")))
    ids = made.withColumn("ids", E.flat_ids(made, "made"))
    return ids.select("conv_id", "turn", F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
