"""Verification, rewards, rates, slices and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rewards as R
from ..functions import text as X
from ..functions import verify as V
from ..operators import sampling, scoring
from .network import CONNECTED, undirected_connectivity
from .points import BOXES, TOPOLOGY, boxes
from .registry import query, table
from .text import ACTS, COMPLETIONS, EXTRACT, NORMAL, ONCE, ORDER, completions

# Right and wrong predictions in mixed case, by row number.
SAID = "CASE {k} % 3 WHEN 0 THEN ' ' || lower({a}) || ' ' WHEN 1 THEN {a} ELSE 'other' END"


def said(key, answer):
    return F.when(key % 3 == 0, F.concat(F.lit(" "), F.lower(answer), F.lit(" "))).when(key % 3 == 1, answer).otherwise("other")


@query("verify_directions", f"WITH {COMPLETIONS}, p AS (SELECT a_id, direction, upper(trim({SAID.format(k='a_id', a='direction')})) AS predicted FROM completions) SELECT a_id, direction AS expected, predicted, predicted = direction AS correct, CASE WHEN predicted = direction THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM p")
def verify_directions(spark, sf):
    c = completions(spark, sf)
    v = V.verified(F.col("direction"), said(F.col("a_id"), F.col("direction")), "upper")
    return c.select("a_id", v.alias("v")).select("a_id", "v.expected", "v.predicted", "v.correct", "v.score")


TITLE = "upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


@query("verify_topology", f"""WITH {BOXES}, t AS (SELECT a.id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM boxes a JOIN boxes b ON b.id = a.id + 1), e AS (SELECT id, {TOPOLOGY} AS expected FROM t), p AS (SELECT id, expected, trim({SAID.format(k='id', a='expected')}) AS s FROM e)
 SELECT id, expected, {TITLE.format(x='s')} AS predicted, {TITLE.format(x='s')} = expected AS correct FROM p""")
def verify_topology(spark, sf):
    b = boxes(spark, sf)
    l, r = b.toDF(*[f"l_{c}" for c in b.columns]), b.toDF(*[f"r_{c}" for c in b.columns])
    a, o = [tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")) for s in ("l", "r")]
    t = l.join(r, F.col("r_id") == F.col("l_id") + 1).select(F.col("l_id").alias("id"), G.box_topology(a, o).alias("expected"))
    return t.select("id", V.verified(F.col("expected"), said(F.col("id"), F.col("expected")), "title").alias("v")).select("id", "v.expected", "v.predicted", "v.correct")


@query("verify_connectivity", f"WITH RECURSIVE{CONNECTED.removeprefix('WITH RECURSIVE').replace('SELECT r.r_regionkey AS region', ', truth AS (SELECT r.r_regionkey AS region')}), p AS (SELECT region, target, answer, trim({SAID.format(k='target', a='answer')}) AS s FROM truth) SELECT region, target, answer AS expected, {TITLE.format(x='s')} = answer AS correct FROM p")
def verify_connectivity(spark, sf):
    c = undirected_connectivity(spark, sf)
    return c.select("region", "target", V.verified(F.col("answer"), said(F.col("target"), F.col("answer")), "title").alias("v")).select("region", "target", "v.expected", "v.correct")


def _any_stage() -> str:
    return " OR ".join(f"regexp_matches(completion, '(?im)^\\s*{s}\\s*:')" for s in X.STAGES)


def _pos(s: str) -> str:
    p = f"'(?im)^\\s*{s}\\s*:\\s*\\S'"
    return f"CASE WHEN regexp_matches(completion, {p}) THEN length(string_split_regex(completion, {p})[1]) + 1 ELSE 0 END"


REWARDS = f"""{COMPLETIONS}, pos AS (SELECT *, [{', '.join(_pos(s) for s in X.STAGES)}] AS places, {EXTRACT} AS answer FROM completions),
 tenths AS (SELECT *, len(list_filter(places, lambda p: p > 0)) * 2 - 4 - CASE WHEN list_filter(places, lambda p: p > 0) = list_sort(list_filter(places, lambda p: p > 0)) THEN 0 ELSE 1 END AS t FROM pos),
 rewards AS (SELECT a_id, completion, direction, answer, CASE WHEN NOT ({_any_stage()}) THEN -1.4 WHEN {NORMAL.format(c='answer')} = lower(direction) THEN 1.0 ELSE -1.0 END AS conclusion, greatest(-4, least(4, t)) / 10.0 AS format FROM tenths)"""


@query("flat_rewards", f"WITH {REWARDS} SELECT a_id, CAST(conclusion AS DOUBLE) AS conclusion, CAST(format AS DOUBLE) AS format, CAST(round((conclusion + format) * 10) AS BIGINT) AS total_tenths FROM rewards")
def flat_rewards(spark, sf):
    c, d = F.col("completion"), F.col("direction")
    return completions(spark, sf).select("a_id", R.conclusion_reward(c, d).alias("conclusion"), R.format_reward(c).alias("format"), F.round(R.flat_reward(c, d) * 10).cast("long").alias("total_tenths"))


@query("map_rewards", f"""WITH {REWARDS}, m AS (SELECT *, 'sign(dx,dy) -> ' || direction AS minimal, {NORMAL.format(c='answer')} = lower(direction) AS ok, upper(trim(answer)) = direction AS gis FROM rewards)
 SELECT a_id, CAST(round(((CASE WHEN ok THEN 1 ELSE -1 END) + (CASE WHEN gis THEN 1 ELSE -1 END) + (CASE WHEN len(list_filter(string_split_regex(lower(replace(minimal, '->', ' ')), '\\s+'), lambda t: length(t) > 1 AND contains(lower(completion), t))) > 0 THEN 0.1 ELSE 0 END) + 0.05 * format / 0.4) * 10000) AS BIGINT) AS total FROM m""")
def map_rewards(spark, sf):
    c, d = F.col("completion"), F.col("direction")
    answer = X.extract_answer(c)
    right = X.normalize_answer(answer) == X.normalize_answer(d)
    gis = V.verified(d, answer, "upper")["correct"]
    r = R.map_reward(right, gis, c, F.concat(F.lit("sign(dx,dy) -> "), d))
    return completions(spark, sf).select("a_id", F.round(r["total"] * 10000).cast("long").alias("total"))


@query("group_advantages", "SELECT event_id, CAST(round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 0.000001) * 1000000) AS BIGINT) AS micro FROM events")
def group_advantages(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return R.group_advantage(e, ["user_id"], "value").select("event_id", F.round(F.col("advantage") * 1000000).cast("long").alias("micro"))


SCORED = f"""{ACTS}, scored AS (SELECT *, CASE WHEN is_final THEN json = '{{"direction":"' || direction || '"}}' ELSE false END AS act_exact, json IS NOT NULL AND is_final AS act_json_valid, {ONCE} AND {ORDER} AND is_final AS ooda_schema_valid,
 CASE a_id % 2 WHEN 0 THEN 'location_direction' ELSE 'location_distance' END AS task FROM acts)"""


def scored(spark, sf):
    c = completions(spark, sf).withColumn("f", X.final_act(F.col("completion")))
    gold = F.concat(F.lit('{"direction":"'), F.col("direction"), F.lit('"}'))
    return c.select("a_id", "direction", F.when(F.col("a_id") % 2 == 0, "location_direction").otherwise("location_distance").alias("task"), F.col("f.error").alias("error"),
                    (F.col("f.is_final") & V.answer_matches(F.col("f.json"), gold)).alias("act_exact"), (F.col("f.json").isNotNull() & F.col("f.is_final")).alias("act_json_valid"), X.stages_in_order(F.col("completion")).alias("ooda_schema_valid"))


@query("completion_scores", f"WITH {SCORED} SELECT a_id, task, error, act_exact, act_json_valid, ooda_schema_valid FROM scored")
def completion_scores(spark, sf):
    return scored(spark, sf).drop("direction")


FLAGS = ["act_exact", "act_json_valid", "ooda_schema_valid"]
_RATES = ", ".join(f"round(avg(CAST(coalesce({f}, false) AS INT)), 6) AS {f}" for f in FLAGS)


@query("score_summary", f"WITH {SCORED}, t AS (SELECT task, count(*) AS n, {_RATES} FROM scored GROUP BY task) SELECT 'task' AS scope, task AS name, n, {', '.join(FLAGS)} FROM t UNION ALL SELECT 'overall', 'all', count(*), {_RATES} FROM scored UNION ALL SELECT 'macro', 'all', count(*), {', '.join(f'round(avg({f}), 6)' for f in FLAGS)} FROM t")
def score_summary(spark, sf):
    return scoring.summary(scored(spark, sf), FLAGS)


@query("error_scenarios", f"WITH {SCORED} SELECT error, CAST(count(*) AS BIGINT) AS n, CAST(min(a_id) AS BIGINT) AS first_id FROM scored WHERE NOT act_exact GROUP BY error")
def error_scenarios(spark, sf):
    return scored(spark, sf).filter("not act_exact").groupBy("error").agg(F.count("*").alias("n"), F.min("a_id").alias("first_id"))


@query("accuracy_sets", """WITH s AS (SELECT event_type, CAST(user_id % 4 AS VARCHAR) AS tier, value > 50 AS ok FROM events) SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'overall' END AS level, coalesce(event_type, tier, 'all') AS name, count(*) AS n, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS correct, sum(CAST(ok AS INT)) / count(*) AS accuracy FROM s GROUP BY GROUPING SETS ((event_type), (tier), ())""")
def accuracy_sets(spark, sf):
    s = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).cast("string").alias("tier"), (F.col("value") > 50).alias("ok"))
    return scoring.accuracy_sets(s, ["event_type", "tier"], "ok")


@query("slice_accuracy", """WITH d AS (SELECT lang, source, quality = 1 AS ok, toxic FROM documents JOIN labels USING (doc_id)), s AS (SELECT unnest(['lang/' || lang, 'source/' || source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END]) AS slice, ok FROM d) SELECT slice, count(*) AS n, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS correct FROM s GROUP BY slice""")
def slice_accuracy(spark, sf):
    """A tag that a row carries twice counts twice, as the evaluator does."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    tag = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return scoring.slices(d, F.array(F.concat(F.lit("lang/"), F.col("lang")), F.concat(F.lit("source/"), F.col("source")), tag, tag), "ok")


@query("quality_gate", """WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents), s AS (SELECT * FROM r WHERE k <= greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)))
 SELECT count(*) AS n, CAST(coalesce(sum(CAST(length(trim(text)) < 20 AS INT)), 0) AS BIGINT) AS failures, 1 - coalesce(sum(CAST(length(trim(text)) < 20 AS INT)), 0) / greatest(count(*), 1) >= 0.98 AS passed FROM s""")
def quality_gate(spark, sf):
    """A tenth of all documents in seeded order (half-to-even size) must pass in 98 of 100 cases."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = docs.count()
    size = max(1, round(n * 0.1))
    sample = docs.orderBy(sampling.seeded(5, F.col("doc_id")), "doc_id").limit(size)
    return scoring.gate(sample, F.length(F.trim("text")) < 20)


@query("duplicate_turns", "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def duplicate_turns(spark, sf):
    return scoring.duplicates(table(spark, sf, "conversations"), "conv_id", "role")


@query("review_metrics", "WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'approved' WHEN toxic = 1 THEN 'rejected' END AS verdict FROM labels) SELECT count(*) AS records, count(verdict) AS labelled, count(*) FILTER (verdict = 'approved') AS approved, round(count(*) FILTER (verdict = 'approved') * 100.0 / nullif(count(verdict), 0), 1) AS percent FROM v")
def review_metrics(spark, sf):
    v = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "rejected").alias("verdict"))
    return scoring.review_metrics(v)
