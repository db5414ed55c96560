"""Joins, contracts, recovery, replacement, splits by city, review samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import text as X
from ..functions import verify as V
from ..operators import joins, records, sampling, scoring, splits
from .registry import query, table

# Concepts with their skills and task types.
TAXONOMY = {"Location": (["relative_direction", "euclidean_distance"], ["direction", "distance"]), "Object": (["topology_relation"], ["topology"]), "Network": (["connectivity", "shortest_path"], ["connectivity", "shortest_path"])}


@query("split_join", """SELECT o_orderkey AS scenario_id, o_orderstatus AS kind, CASE WHEN c_nationkey % 10 < 8 THEN 'train' WHEN c_nationkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM orders JOIN customer ON o_custkey = c_custkey""")
def split_join(spark, sf):
    """Every record must have a split; a record without raises."""
    k = F.col("c_nationkey") % 10
    split = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(k < 8, "train").when(k == 8, "validation").otherwise("test").alias("split"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return joins.must_match(rows, split, "o_custkey").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderstatus").alias("kind"), "split")


@query("unmatched_customers", "SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmatched_customers(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("customer"))


RECOVER = """rejected AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), known AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), emitted AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("recovered_rows", f"""WITH {RECOVER} SELECT k AS scenario_id, CASE WHEN k NOT IN (SELECT k FROM known) THEN 'unknown' WHEN k IN (SELECT k FROM emitted) THEN 'already emitted' WHEN NOT v > 1000 THEN 'still invalid' ELSE 'recovered' END AS outcome FROM rejected""")
def recovered_rows(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").alias("k")
    rejected = o.filter("o_orderstatus = 'F'").select(k, F.col("o_totalprice").alias("v"))
    known = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    good, bad = records.recover(rejected, known, o.filter("o_orderpriority = '1-URGENT'").select(k), "k", F.col("v") > 1000)
    return good.select("k", F.lit("recovered").alias("outcome")).union(bad.select("k", "reason")).select(F.col("k").alias("scenario_id"), "outcome")


@query("replaced_rows", """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS content FROM orders""")
def replaced_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("content"), "o_orderstatus")
    due = o.filter("o_orderstatus = 'P'")
    new = due.select("k", F.concat(F.upper("content"), F.lit("!")).alias("content"))
    return records.replace_checked(o.select("k", "content"), new, "k", due.select("k"))


@query("set_differences", """WITH f AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT k, 'left' AS side FROM (SELECT k FROM f EXCEPT SELECT k FROM p) UNION ALL SELECT k, 'right' FROM (SELECT k FROM p EXCEPT SELECT k FROM f)""")
def set_differences(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return joins.difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "k")


@query("unseen_city_split", """SELECT c_custkey AS id, r_name AS city, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'test' ELSE 'train' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def unseen_city_split(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("id"), F.col("r_name").alias("city"), F.lit("real_gis").alias("source_type"))
    return splits.unseen_city(rows, ["ASIA", "EUROPE"]).select("id", "city", "split")


@query("taxonomy_problems", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Location' WHEN 1 THEN 'Object' WHEN 2 THEN 'Network' ELSE 'Time' END AS concept, CASE event_id % 3 WHEN 0 THEN 'relative_direction' WHEN 1 THEN 'topology_relation' ELSE 'connectivity' END AS skill, CASE event_id % 5 WHEN 0 THEN 'direction' WHEN 1 THEN 'topology' ELSE 'connectivity' END AS task_type FROM events),
 t AS (SELECT * FROM (VALUES ('Location', ['relative_direction', 'euclidean_distance'], ['direction', 'distance']), ('Object', ['topology_relation'], ['topology']), ('Network', ['connectivity', 'shortest_path'], ['connectivity', 'shortest_path'])) v(concept, skills, types))
 SELECT event_id, concat_ws(',', CASE WHEN t.concept IS NULL THEN 'unknown concept' END, CASE WHEN NOT list_contains(skills, skill) THEN 'skill outside concept' END, CASE WHEN NOT list_contains(types, task_type) THEN 'task type outside concept' END) AS problems FROM e LEFT JOIN t ON e.concept = t.concept""")
def taxonomy_problems(spark, sf):
    e = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (e % n + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", pick(4, "Location", "Object", "Network", "Time").alias("concept"), pick(3, "relative_direction", "topology_relation", "connectivity").alias("skill"), pick(5, "direction", "topology", "connectivity", "connectivity", "connectivity").alias("task_type"))
    t = spark.createDataFrame([(c, *v) for c, v in TAXONOMY.items()], "concept string, skills array<string>, task_types array<string>")
    return records.taxonomy_violations(rows, t).select("event_id", F.array_join("problems", ",").alias("problems"))


@query("review_round_robin", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260920:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, lang, CAST(turn AS BIGINT) AS turn FROM r ORDER BY turn, lang LIMIT 50""")
def review_round_robin(spark, sf):
    """A review sample of fifty, one language at a time."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.take_round_robin(docs, "lang", [sampling.seeded(20260920, F.col("doc_id")), "doc_id"], 50).select("doc_id", "lang", F.col("turn").cast("long"))


@query("heads_per_source", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 3")
def heads_per_source(spark, sf):
    """The first rows of each file come before any other filter."""
    return sampling.head_per_group(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 3)


@query("message_contract", """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations), m AS (SELECT conv_id, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts FROM t GROUP BY conv_id)
 SELECT conv_id, concat_ws(',', CASE WHEN len(roles) <> 2 THEN 'two messages' END, CASE WHEN NOT coalesce(roles[1] = 'user' AND roles[2] = 'assistant', false) THEN 'user then assistant' END, CASE WHEN NOT coalesce(len(list_filter(texts, lambda x: trim(x) = '')) = 0, false) THEN 'content' END) AS problems FROM m""")
def message_contract(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    checks = [(F.size("m") == 2, "two messages"), ((F.get(roles, 0) == "user") & (F.get(roles, 1) == "assistant"), "user then assistant"), (F.forall("m", lambda x: F.trim(x["text"]) != ""), "content")]
    return c.select("conv_id", F.array_join(scoring.violations(checks), ",").alias("problems"))


@query("two_message_records", """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations), m AS (SELECT conv_id, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts FROM t GROUP BY conv_id)
 SELECT conv_id, coalesce(len(roles) = 2 AND roles[1] = 'user' AND roles[2] = 'assistant' AND trim(texts[2]) <> '', false) AS ok FROM m""")
def two_message_records(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    return c.select("conv_id", F.coalesce(V.two_messages(F.col("m")), F.lit(False)).alias("ok"))


@query("provenance_checks", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'ODbL' END AS license, coalesce(trim(CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'ODbL' END) <> '', false) AS complete, s_suppkey % 3 = 0 AS needs_crs, coalesce(regexp_matches(lower(trim(s_name)), '^[a-z0-9][a-z0-9_-]*$'), false) AS token FROM supplier""")
def provenance_checks(spark, sf):
    k = F.col("s_suppkey")
    lic = F.when(k % 4 == 0, " ").when(k % 4 == 1, None).otherwise("ODbL")
    crs = F.when(k % 3 == 0, "epsg:4326").otherwise("EPSG:32650")
    return table(spark, sf, "supplier").select(k.alias("id"), lic.alias("license"), T.provenance_complete(F.col("s_name"), lic).alias("complete"), T.needs_analysis_crs(crs, F.lit(None).cast("string")).alias("needs_crs"), T.valid_token(F.col("s_name")).alias("token"))


@query("page_basenames", r"SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages")
def page_basenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_basename(F.col("url")).alias("name"))


@query("style_pivot", """WITH s AS (SELECT o_orderkey AS k, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS qa, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS minimal, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS ooda FROM orders JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) ON o_orderkey = l_orderkey GROUP BY 1) SELECT k, qa, minimal, ooda FROM s WHERE ooda IS NOT NULL""")
def style_pivot(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("content"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    name = F.element_at(F.create_map(F.lit(1), F.lit("qa"), F.lit(2), F.lit("minimal"), F.lit(3), F.lit("ooda")), F.col("l_linenumber").cast("int"))
    rows = l.join(o, "l_orderkey").select(F.col("l_orderkey").alias("k"), name.alias("style"), "content")
    whole = rows.groupBy("k").agg(F.max(F.col("style") == "ooda").alias("has")).filter("has").select("k")
    return records.styles_by_scenario(rows.join(whole, "k", "left_semi"), ["qa", "minimal", "ooda"], "ooda", key="k")


@query("manifest_counts", "SELECT lang AS split, source AS style, count(*) AS n FROM documents GROUP BY 1, 2")
def manifest_counts(spark, sf):
    return records.manifest_counts(table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("source").alias("style")), ["split", "style"])


@query("entity_refs", "SELECT o_custkey AS key, array_to_string(list_sort(list(DISTINCT 'order/' || o_orderstatus)), ',') AS refs FROM orders GROUP BY 1")
def entity_refs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.concat(F.lit("order/"), F.col("o_orderstatus")).alias("ref"))
    return records.entity_refs(o, "key", "ref").select("key", F.array_join("entity_refs", ",").alias("refs"))


@query("review_markdown", """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents), s AS (SELECT * FROM r ORDER BY turn, lang LIMIT 8)
 SELECT string_agg('## ' || doc_id || chr(10) || chr(10) || '**lang**' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '**source**' || chr(10) || chr(10) || source, chr(10) || chr(10) ORDER BY doc_id) AS markdown FROM s""")
def review_markdown(spark, sf):
    s = records.review_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", ["doc_id"], 8)
    return records.review_markdown(s.withColumn("title", F.col("doc_id").cast("string")), "title", "doc_id", ["lang", "source"])


@query("rewrite_problems", """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Where is p2?' WHEN 1 THEN 'Task: where?' WHEN 2 THEN 'Where is p2' ELSE ' ' END AS q, CASE WHEN doc_id % 3 = 0 THEN '[1]' ELSE '{"direction":"N"}' END AS act FROM documents)
 SELECT doc_id, concat_ws(',', CASE WHEN trim(q) = '' THEN 'blank field' END, CASE WHEN NOT ends_with(trim(q), '?') THEN 'question is not one line ending in ?' END, CASE WHEN contains(lower(q), 'task:') THEN 'question repeats the scene' END, CASE WHEN act = '[1]' THEN 'act is not an object' END) AS problems FROM r""")
def rewrite_problems(spark, sf):
    k = F.col("doc_id")
    q = F.when(k % 4 == 0, "Where is p2?").when(k % 4 == 1, "Task: where?").when(k % 4 == 2, "Where is p2").otherwise(" ")
    act = F.when(k % 3 == 0, "[1]").otherwise('{"direction":"N"}')
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.rewrite_violations(q, [F.lit("a"), F.lit("b")], act), ",").alias("problems"))
