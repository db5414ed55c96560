"""Directed weighted graphs as edge tables ``(src, dst, cost)``.

Iterative operators keep only what changed in a round, cut lineage with a
checkpoint, and bring a count to the driver, never rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .sampling import head_per_group

#: Parts into which the edges of one node are dealt in a round of ``connected``.
SALTS = 256


def collapse_parallel(edges: DataFrame, order: list[str]) -> DataFrame:
    """The cheapest of parallel edges, the first in ``order`` among equals, with the other columns of that edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    best = F.min_by(F.struct(*rest), F.struct("cost", *order))
    return edges.groupBy("src", "dst").agg(best.alias("e"), F.count("*").alias("parallel")).select("src", "dst", "e.*", "parallel")


def cheapest_out(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` cheapest edges out of each node."""
    return head_per_group(edges, ["src"], ["cost", "dst"], k)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Components of undirected ``(src, dst)`` long edges: ``(node, component)``, component the smallest id reachable.

    Alternating large-star and small-star rounds (edges only shrink towards the
    smallest neighbour, O(log n) rounds), each cut by a checkpoint.  The edges of a
    node are dealt out by ``SALTS`` hashes of their other ends, so a hub that a third
    of all edges meet is no single task.  Only a count and a checksum per round reach
    the driver.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("dst"), F.col("src"))).toDF("u", "v")
        else:
            both = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        # dealt out once, for the minima of the parts and for the join; at most SALTS rows a node meet by node
        both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("short")).repartition("u", "salt")
        parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
        least = parts.withColumn("m", F.least(F.min("m").over(Window.partitionBy("u")), "u"))
        out = both.join(least, ["u", "salt"])
        if large:
            # one row an edge, as before; the small star makes them distinct
            return out.filter("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).filter("src <> dst")
        out = out.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select("u", "m").distinct())
        return out.filter("src <> dst").distinct()

    e = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst").distinct())
    seen = None
    while True:
        e = cut(star(star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    top = e.groupBy("src").agg(F.min("dst").alias("component")).toDF("node", "component")
    roots = top.select(F.col("component").alias("node"), "component").distinct()
    return top.union(roots)


def closure(edges: DataFrame) -> DataFrame:
    """All ``(src, dst)`` joined by a directed path of one edge or more (semi-naive: only new pairs are extended)."""
    step = cut(edges.select("src", "dst").distinct())
    known = new = step
    while not new.isEmpty():
        longer = new.select("src", F.col("dst").alias("mid")).join(step.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        new = cut(longer.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.union(new))
    return known


def shortest_costs(edges: DataFrame) -> DataFrame:
    """``(src, dst, cost)``: least cost of a directed path of one edge or more; costs are not negative.

    Each round extends only the distances that the last one improved.
    """
    step = cut(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    best = new = step
    while not new.isEmpty():
        longer = new.select("src", F.col("dst").alias("mid"), F.col("cost").alias("c")).join(step.toDF("mid", "dst", "leg"), "mid")
        found = longer.groupBy("src", "dst").agg(F.min(F.col("c") + F.col("leg")).alias("cost"))
        old = best.select("src", "dst", F.col("cost").alias("old"))
        new = cut(found.join(old, ["src", "dst"], "left").filter("old is null or cost < old").select("src", "dst", "cost"))
        best = cut(best.union(new).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    return best


def ball(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(seed, node, hops)``: nodes within ``hops`` steps, directions ignored; a seed is 0 steps from itself."""
    near = both_ways(edges)
    known = new = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    for h in range(1, hops + 1):
        far = new.select("seed", F.col("node").alias("src")).join(near, "src").select("seed", F.col("dst").alias("node")).distinct()
        new = cut(far.join(known, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h)))
        known = cut(known.unionByName(new))
    return known


def simple_paths(edges: DataFrame, hops: int) -> DataFrame:
    """``(src, dst, path, cost)``: all paths without repeated nodes of at most ``hops`` edges.

    Meant for scenes of bounded size: the number of paths grows with the degree to the power of ``hops``.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("cost").alias("leg"))
    level = edges.filter("src <> dst").select("src", "dst", F.array("src", "dst").alias("path"), "cost")
    out = level
    for _ in range(hops - 1):
        grown = level.join(step, level["dst"] == step["at"]).filter(~F.array_contains("path", F.col("next")))
        level = cut(grown.select("src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path"), (F.col("cost") + F.col("leg")).alias("cost")))
        out = out.unionByName(level)
    return out


def k_best(paths: DataFrame, k: int) -> DataFrame:
    """Ranked paths of each pair: by cost, then fewer nodes, then the path itself."""
    w = Window.partitionBy("src", "dst").orderBy("cost", F.size("path"), "path")
    return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(edges: DataFrame, hops: int) -> DataFrame:
    """``(src, dst)`` joined by a directed path of 1 to ``hops`` edges, ends apart: only new pairs are extended."""
    step = edges.select("src", "dst").distinct()
    known = new = step
    for _ in range(hops - 1):
        longer = new.select("src", F.col("dst").alias("mid")).join(step.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        new = cut(longer.join(known, ["src", "dst"], "left_anti"))
        known = known.union(new)
    return known.filter("src <> dst")


def _to_target(back: dict, target) -> dict:
    """Least cost from every node that reaches ``target``."""
    cost, queue = {}, [(0, target)]
    while queue:
        c, node = heapq.heappop(queue)
        if node not in cost:
            cost[node] = c
            for other, leg in back.get(node, ()):
                if other not in cost:
                    heapq.heappush(queue, (c + leg, other))
    return cost


def _cheapest_simple(near: dict, rest: dict, source, target, k: int) -> list[tuple[int, list]]:
    """The ``k`` first simple paths by (cost, nodes, path): partial paths open in order of their least possible total, so no more are grown than needed."""
    found, queue = [], [(rest[source], 0, [source])] if source in rest else []
    while queue and not (len(found) >= k and queue[0][0] > found[k - 1][0]):
        _, cost, path = heapq.heappop(queue)
        if path[-1] == target:
            found.append((cost, len(path), path))
            found.sort()
            continue
        for node, leg in near.get(path[-1], ()):
            if node in rest and node not in path:
                heapq.heappush(queue, (cost + leg + rest[node], cost + leg, [*path, node]))
    return [(c, p) for c, _, p in found[:k]]


#: Edges of a network whose best paths are searched as one scene.
SCENE_EDGES = 100_000


def best_paths(edges: DataFrame, k: int) -> DataFrame:
    """``(src, dst, rank, path, cost)``: the ``k`` best simple paths of every pair of different nodes, of any length, ranked by cost, then fewer nodes, then the path.

    The network travels to the tasks as one bounded scene (more than ``SCENE_EDGES``
    edges are refused); the sources are dealt out.  Costs are whole numbers and not negative.
    """
    net = cut(edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    if net.count() > SCENE_EDGES:
        raise ValueError(f"a network of more than {SCENE_EDGES} edges is no scene; use shortest_costs")
    kind = net.schema["src"].dataType.simpleString()
    links = net.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "cost"))).alias("links"))
    sources = net.select("src").distinct().repartition("src")

    @F.pandas_udf(f"array<struct<dst:{kind},rank:int,path:array<{kind}>,cost:bigint>>")
    def search(source: pd.Series, scene: pd.Series) -> pd.Series:
        near, back, out = {}, {}, []
        for x in scene.iloc[0] if len(scene) else ():
            near.setdefault(x["src"], []).append((x["dst"], x["cost"]))
            back.setdefault(x["dst"], []).append((x["src"], x["cost"]))
        rests = {target: _to_target(back, target) for target in sorted(back)}
        for src in source:
            out.append([{"dst": t, "rank": n, "path": path, "cost": cost} for t, rest in rests.items() if t != src for n, (cost, path) in enumerate(_cheapest_simple(near, rest, src, t, k), 1)])
        return pd.Series(out)

    # one row of a checked size
    return sources.crossJoin(F.broadcast(links)).select("src", F.inline(search("src", "links"))).select("src", "dst", "rank", "path", "cost")


def choose_queries(ranked: DataFrame, nodes: int = 3) -> DataFrame:
    """``(src, dst, path, cost, runner_up_path, runner_up_cost)`` of pairs with two paths (ranked here unless they are) whose best is unique and has ``nodes`` nodes or more."""
    ranked = ranked if "rank" in ranked.columns else k_best(ranked, 2)
    top = ranked.groupBy("src", "dst").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("path", "cost"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("path", "cost"))).alias("b"))
    good = top.filter(F.col("b").isNotNull() & (F.col("a.cost") < F.col("b.cost")) & (F.size("a.path") >= nodes))
    return good.select("src", "dst", "a.path", "a.cost", F.col("b.path").alias("runner_up_path"), F.col("b.cost").alias("runner_up_cost"))


def check_paths(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns with (hops, legal, cost): whether every leg of ``path`` is an edge, and the cheapest legs' sum."""
    n = F.size("path")
    legs = F.arrays_zip(F.slice("path", 1, F.greatest(n - 1, F.lit(0))).alias("src"), F.slice("path", 2, F.greatest(n - 1, F.lit(0))).alias("dst"))
    each = paths.select(*key, n.alias("n"), F.explode_outer(legs).alias("leg")).select(*key, "n", F.col("leg.src").alias("src"), F.col("leg.dst").alias("dst"))
    cheap = edges.groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return each.join(cheap, ["src", "dst"], "left").groupBy(*key).agg(
        (F.max("n") - 1).alias("hops"), ((F.max("n") >= 2) & (F.count("cost") == F.max("n") - 1)).alias("legal"), F.sum("cost").alias("cost"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of every scene with both ends in it; ``members``: (scene, node)."""
    a, b = members.toDF("scene", "src"), members.toDF("scene", "dst")
    return edges.join(a, "src").join(b, ["scene", "dst"]).select("scene", "src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])


def aliases(members: DataFrame) -> DataFrame:
    """``(scene, node, alias)``: the scene's source is n1, its target n2, the rest follow by node; ``members``: (scene, node, source, target)."""
    w = Window.partitionBy("scene").orderBy(F.desc(F.col("node") == F.col("source")), F.desc(F.col("node") == F.col("target")), "node")
    return members.select("scene", "node", F.concat(F.lit("n"), F.row_number().over(w)).alias("alias"))


def anonymous_nodes(members: DataFrame) -> DataFrame:
    """``(scene, node, alias)``: Node 1, Node 2, ... by node id."""
    w = Window.partitionBy("scene").orderBy("node")
    return members.select("scene", "node", F.concat(F.lit("Node "), F.dense_rank().over(w)).alias("alias"))


def _first_path(links: list[tuple[str, str]], source: str, target: str) -> list[str] | None:
    near: dict[str, list[str]] = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    came, ring = {source: None}, [source]
    while ring and target not in came:
        nxt = []
        for node in ring:
            for other in near.get(node, []):
                if other not in came:
                    came[other] = node
                    nxt.append(other)
        ring = nxt
    if target not in came:
        return None
    path = [target]
    while came[path[-1]] is not None:
        path.append(came[path[-1]])
    return path[::-1]


def witness_paths(scenes: DataFrame) -> DataFrame:
    """``(scene, path)``: a shortest undirected path found breadth first, links in given order; null without any.

    ``scenes``: (scene, links ARRAY<STRUCT<a, b>>, source, target), one bounded scene a row.
    """
    @F.pandas_udf("array<string>")
    def find(links: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([_first_path([(x["a"], x["b"]) for x in rows], s, t) for rows, s, t in zip(links, source, target)])

    return scenes.select("scene", find("links", "source", "target").alias("path"))


def path_edges(paths: DataFrame, edges: DataFrame, key: list[str], edge_id: str = "edge_id") -> DataFrame:
    """``key`` columns with ``edge_ids``: the cheapest edge of every leg of ``path``, in order."""
    cheap = edges.groupBy("src", "dst").agg(F.min_by(edge_id, F.struct("cost", edge_id)).alias("e"))
    n = F.greatest(F.size("path") - 1, F.lit(0))
    legs = F.arrays_zip(F.slice("path", 1, n).alias("src"), F.slice("path", 2, n).alias("dst"))
    each = paths.select(*key, F.posexplode(legs).alias("at", "leg")).select(*key, "at", F.col("leg.src").alias("src"), F.col("leg.dst").alias("dst"))
    got = each.join(cheap, ["src", "dst"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("s"))
    return got.select(*key, F.transform("s", lambda x: x["e"]).alias("edge_ids"))
