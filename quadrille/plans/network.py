"""A directed trade network between nations: parallel edges, reachability, paths, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import graph
from .registry import query, table

# An edge is a line sold from a supplier's nation to a customer's; the network keeps the two cheapest ways out of each nation.
LINES = """lines AS (SELECT s.s_nationkey AS src, c.c_nationkey AS dst, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cost, l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""
CHEAP = f"{LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY cost, ok, ln, pk) AS n, count(*) OVER (PARTITION BY src, dst) AS parallel FROM lines), cheap AS (SELECT src, dst, cost, ok, ln, parallel FROM ranked WHERE n = 1)"
NET = f"{CHEAP}, net AS MATERIALIZED (SELECT src, dst, cost FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cost, dst) AS k FROM cheap WHERE src <> dst) WHERE k <= 2)"
PATHS = NET + """, paths AS (SELECT src, dst, [src, dst] AS path, cost, 1 AS hops FROM net UNION ALL
 SELECT p.src, e.dst, list_append(p.path, e.dst), p.cost + e.cost, p.hops + 1 FROM paths p JOIN net e ON p.dst = e.src WHERE NOT list_contains(p.path, e.dst) AND p.hops < {hops})"""
# A simple path among 25 nations has at most 24 edges: no cap.
RANKED = PATHS.format(hops=24) + ", best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY cost, len(path), path) AS rank FROM paths)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    l, o, c, s = (table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    return j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"))


def cheap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.collapse_parallel(lines(spark, sf), ["ok", "ln", "pk"])


def network(spark: SparkSession, sf: str) -> DataFrame:
    """Computed once: what walks it reads its few rows, never the facts again."""
    return cut(graph.cheapest_out(cheap(spark, sf).filter("src <> dst").select("src", "dst", "cost"), 2))


@query("min_parallel_edges", f"WITH {CHEAP} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, cost, ok AS order_key, CAST(ln AS BIGINT) AS line, CAST(parallel AS BIGINT) AS parallel FROM cheap")
def min_parallel_edges(spark, sf):
    return cheap(spark, sf).select(F.col("src").cast("long"), F.col("dst").cast("long"), "cost", F.col("ok").alias("order_key"), F.col("ln").cast("long").alias("line"), "parallel")


@query("reachable_pairs", f"WITH RECURSIVE {NET}, reach AS (SELECT src, dst FROM net UNION SELECT r.src, e.dst FROM reach r JOIN net e ON r.dst = e.src) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM reach")
def reachable_pairs(spark, sf):
    return graph.closure(network(spark, sf)).select(F.col("src").cast("long"), F.col("dst").cast("long"))


@query("weak_components", f"WITH RECURSIVE {NET}, both_ways AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), reach AS (SELECT src, src AS dst FROM both_ways UNION SELECT r.src, e.dst FROM reach r JOIN both_ways e ON r.dst = e.src) SELECT CAST(src AS BIGINT) AS node, CAST(min(dst) AS BIGINT) AS component FROM reach GROUP BY src")
def weak_components(spark, sf):
    return graph.connected(network(spark, sf))


CONNECTED = f"""WITH RECURSIVE {NET}, both_ways AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), reach AS (SELECT n_nationkey AS src, n_nationkey AS dst FROM nation UNION SELECT r.src, e.dst FROM reach r JOIN both_ways e ON r.dst = e.src)
 SELECT r.r_regionkey AS region, n.n_nationkey AS target, CASE WHEN EXISTS (SELECT 1 FROM reach WHERE src = r.r_regionkey AND dst = n.n_nationkey) THEN 'Connected' ELSE 'Disconnected' END AS answer FROM region r, nation n"""


@query("undirected_connectivity", CONNECTED)
def undirected_connectivity(spark, sf):
    """Pairs of a source (one a region) and every nation: same component or not."""
    comp = graph.connected(network(spark, sf))
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    named = nodes.join(comp, "node", "left").select("node", F.coalesce("component", F.col("node").cast("long")).alias("component"))
    sources = table(spark, sf, "region").select(F.col("r_regionkey").alias("region")).join(named.toDF("region", "c"), "region")
    pairs = sources.crossJoin(F.broadcast(named.toDF("target", "d")))  # 5 regions by 25 nations: fixed dimension tables
    return pairs.select("region", "target", F.when(F.col("c") == F.col("d"), "Connected").otherwise("Disconnected").alias("answer"))


@query("khop_balls", f"""WITH RECURSIVE {NET}, both_ways AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), walk AS (SELECT n_nationkey AS seed, n_nationkey AS node, 0 AS h FROM nation UNION SELECT w.seed, e.dst, w.h + 1 FROM walk w JOIN both_ways e ON w.node = e.src WHERE w.h < 3)
 SELECT CAST(seed AS BIGINT) AS seed, CAST(count(DISTINCT node) AS BIGINT) AS nodes FROM walk GROUP BY seed""")
def khop_balls(spark, sf):
    seeds = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.ball(network(spark, sf), seeds, 3).groupBy(F.col("seed").cast("long").alias("seed")).agg(F.count("*").alias("nodes"))


@query("shortest_costs", f"WITH RECURSIVE {PATHS.format(hops=24)} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(min(cost) AS BIGINT) AS cost FROM paths GROUP BY src, dst")
def shortest_costs(spark, sf):
    return graph.shortest_costs(network(spark, sf)).filter("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), "cost")


@query("k_best_paths", f"WITH RECURSIVE {RANKED} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(rank AS BIGINT) AS rank, array_to_string(path, ' -> ') AS path, CAST(cost AS BIGINT) AS cost FROM best WHERE rank <= 2")
def k_best_paths(spark, sf):
    best = graph.best_paths(network(spark, sf), 2)
    return best.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("rank").cast("long"), F.array_join("path", " -> ").alias("path"), "cost")


CHOSEN = RANKED + """, chosen AS MATERIALIZED (SELECT a.src, a.dst, a.path, a.cost, b.path AS path2, b.cost AS cost2 FROM best a JOIN best b ON a.src = b.src AND a.dst = b.dst AND a.rank = 1 AND b.rank = 2 WHERE a.cost < b.cost AND len(a.path) >= 3)"""


@query("path_queries", f"WITH RECURSIVE {CHOSEN} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, array_to_string(path, ' -> ') AS path, CAST(cost AS BIGINT) AS cost, array_to_string(path2, ' -> ') AS runner_up, CAST(cost2 AS BIGINT) AS runner_up_cost FROM chosen")
def path_queries(spark, sf):
    q = graph.choose_queries(graph.best_paths(network(spark, sf), 2))
    return q.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.array_join("path", " -> ").alias("path"), "cost", F.array_join("runner_up_path", " -> ").alias("runner_up"), "runner_up_cost")


@query("path_legality", f"""WITH {NET}, cand AS (SELECT e.src, e.dst, n.n_nationkey AS last, e.cost AS first_cost FROM net e, nation n)
 SELECT CAST(c.src AS BIGINT) AS a, CAST(c.dst AS BIGINT) AS b, CAST(c.last AS BIGINT) AS c, e.cost IS NOT NULL AS legal, CAST(c.first_cost + coalesce(e.cost, 0) AS BIGINT) AS cost FROM cand c LEFT JOIN net e ON e.src = c.dst AND e.dst = c.last""")
def path_legality(spark, sf):
    """Paths of two hops, each edge continued to every nation whether or not it can be."""
    net = network(spark, sf)
    nations = table(spark, sf, "nation").select("n_nationkey")
    cand = net.crossJoin(F.broadcast(nations)).select("src", "dst", F.col("n_nationkey").alias("last"))  # 25 nations: a fixed dimension table
    paths = cand.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("last").alias("c"), F.array("src", "dst", "last").alias("path"))
    out = graph.check_paths(paths, net, ["a", "b", "c"])
    return out.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("c").cast("long"), "legal", "cost")


@query("scene_aliases", f"""WITH RECURSIVE {CHOSEN}, scenes AS (SELECT DISTINCT src || '-' || dst AS scene, src, dst, unnest(list_distinct(list_concat(path, path2))) AS node FROM chosen)
 SELECT scene, CAST(node AS BIGINT) AS node, 'n' || row_number() OVER (PARTITION BY scene ORDER BY (node = src) DESC, (node = dst) DESC, node) AS alias FROM scenes""")
def scene_aliases(spark, sf):
    q = graph.choose_queries(graph.best_paths(network(spark, sf), 2))
    members = q.select(F.concat_ws("-", "src", "dst").alias("scene"), F.explode(F.array_union("path", "runner_up_path")).alias("node"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return graph.aliases(members).select("scene", F.col("node").cast("long"), "alias")


@query("scene_edges", f"""WITH RECURSIVE {CHOSEN}, scenes AS (SELECT DISTINCT src || '-' || dst AS scene, unnest(list_distinct(list_concat(path, path2))) AS node FROM chosen)
 SELECT a.scene, CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst, CAST(e.cost AS BIGINT) AS cost FROM net e JOIN scenes a ON a.node = e.src JOIN scenes b ON b.scene = a.scene AND b.node = e.dst""")
def scene_edges(spark, sf):
    net = network(spark, sf)
    q = graph.choose_queries(graph.best_paths(net, 2))
    members = q.select(F.concat_ws("-", "src", "dst").alias("scene"), F.explode(F.array_union("path", "runner_up_path")).alias("node"))
    return graph.induced(net, members).select("scene", F.col("src").cast("long"), F.col("dst").cast("long"), "cost")


@query("connectivity_queries", f"""WITH RECURSIVE {PATHS.format(hops=4)}, reach AS (SELECT src, dst FROM net UNION SELECT r.src, e.dst FROM reach r JOIN net e ON r.dst = e.src),
 both_ways AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), weak AS (SELECT src, dst FROM both_ways UNION SELECT w.src, e.dst FROM weak w JOIN both_ways e ON w.dst = e.src), hops AS (SELECT src, dst, min(hops) AS h FROM paths GROUP BY src, dst)
 SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, true AS connected FROM hops WHERE src <> dst UNION ALL SELECT CAST(w.src AS BIGINT), CAST(w.dst AS BIGINT), false FROM weak w WHERE w.src <> w.dst AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.src = w.src AND r.dst = w.dst)""")
def connectivity_queries(spark, sf):
    """Candidates: reachable within two to five nodes, or in one weak component but unreachable."""
    net = network(spark, sf)
    yes = graph.within(net, 4).withColumn("connected", F.lit(True))
    comp = graph.connected(net)
    weak = comp.toDF("src", "c").join(comp.toDF("dst", "c"), "c").filter("src <> dst").select("src", "dst")
    no = weak.join(graph.closure(net), ["src", "dst"], "left_anti").withColumn("connected", F.lit(False))
    return yes.union(no).select(F.col("src").cast("long"), F.col("dst").cast("long"), "connected")


@query("witness_paths")
def witness_paths(spark, sf):
    """Breadth-first witness inside each region's scene of undirected links."""
    net = network(spark, sf).select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    scene = net.agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("links"))
    asked = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("source"), F.col("n_nationkey").cast("string").alias("target"))
    rows = asked.crossJoin(F.broadcast(scene)).select(F.concat_ws("-", "source", "target").alias("scene"), "links", "source", "target")  # one row of at most 50 links
    return graph.witness_paths(rows).select("scene", F.array_join("path", " -> ").alias("path"))
