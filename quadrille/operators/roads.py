"""From ways to a directed road graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Strictly inside."""
    return (x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3])


def meets(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    return (x1 <= box[2]) & (x2 >= box[0]) & (y1 <= box[3]) & (y2 >= box[1])


def junctions(ways: DataFrame) -> DataFrame:
    """``(node, is_intersection)``: ends of ways, and nodes passed more than once (a loop's closing node included).

    ``ways``: (way, nodes ARRAY<STRUCT<node, ...>>).
    """
    each = ways.select(F.posexplode("nodes").alias("pos", "n"), F.size("nodes").alias("size"))
    uses = each.groupBy(F.col("n.node").alias("node")).agg(F.count("*").alias("uses"), F.max((F.col("pos") == 0) | (F.col("pos") == F.col("size") - 1)).alias("end"))
    return uses.filter("uses > 1 or end").select("node", (F.col("uses") > 1).alias("is_intersection"))


def segments(ways: DataFrame) -> DataFrame:
    """``(way, segment, a, b, path)``: pieces of a way between consecutive break nodes."""
    breaks = junctions(ways).select("node", F.lit(True).alias("cut"))
    each = ways.select("way", F.posexplode("nodes").alias("pos", "n")).select("way", "pos", "n", F.col("n.node").alias("node"))
    marked = each.join(breaks, "node", "left").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "cut"))).alias("s"))
    cuts = F.filter("s", lambda p: p["cut"])
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(1))), lambda i: F.struct(i.cast("long").alias("segment"), F.element_at("cuts", i)["pos"].alias("p0"), F.get("cuts", i)["pos"].alias("p1")))
    out = marked.withColumn("cuts", cuts).filter(F.size("cuts") > 1).select("way", "s", F.explode(pieces).alias("p"))
    path = F.transform(F.slice("s", F.col("p.p0") + 1, F.col("p.p1") - F.col("p.p0") + 1), lambda x: x["n"])
    return out.select("way", "p.segment", path.alias("path")).select("way", "segment", F.element_at("path", 1)["node"].alias("a"), F.element_at("path", -1)["node"].alias("b"), "path")


def directed(segments: DataFrame) -> DataFrame:
    """``(edge_id, way, from_node, to_node, path)``: one row a permitted direction (``travel`` STRUCT<fwd, rev>)."""
    tag = F.concat_ws("-", F.col("way").cast("string"), F.col("segment").cast("string"))
    fwd = F.when(F.col("travel.fwd"), F.struct(F.concat(tag, F.lit("-f")).alias("edge_id"), F.col("a").alias("from_node"), F.col("b").alias("to_node"), F.col("path")))
    rev = F.when(F.col("travel.rev"), F.struct(F.concat(tag, F.lit("-r")).alias("edge_id"), F.col("b").alias("from_node"), F.col("a").alias("to_node"), F.reverse("path").alias("path")))
    return segments.select("way", F.explode(F.array_compact(F.array(fwd, rev))).alias("e")).select("e.edge_id", "way", "e.from_node", "e.to_node", "e.path")
