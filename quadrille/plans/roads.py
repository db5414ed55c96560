"""Roads: tags, permissions, break nodes, segments, directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import roads
from .registry import query, table

# Orders stand for ways, their lines for the nodes they pass (part keys), in line order.
TAGS = """tags AS (SELECT o_orderkey AS way, CASE o_orderstatus WHEN 'O' THEN 'residential' WHEN 'F' THEN 'primary' ELSE 'footway' END AS highway,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'private' WHEN '2' THEN 'yes' WHEN '3' THEN 'no' ELSE NULL END AS access,
 CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' ELSE NULL END AS oneway, CASE WHEN o_orderkey % 7 = 0 THEN 'roundabout' END AS junction FROM orders)"""
DRIVE = "coalesce(highway IN (" + ", ".join(f"'{x}'" for x in T.DRIVABLE) + "), false) AND NOT coalesce(access IN ('no', 'private'), false)"
ONLY = "(lower(coalesce(oneway, '')) IN ('yes', 'true', '1') OR coalesce(junction = 'roundabout', false))"
WAYS = "steps AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey AS node, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"
BREAKS = f"{WAYS}, uses AS (SELECT node, count(*) AS n FROM steps GROUP BY node), lens AS (SELECT way, max(pos) AS m FROM steps GROUP BY way), breaks AS (SELECT node FROM uses WHERE n > 1 UNION SELECT node FROM steps JOIN lens USING (way) WHERE pos = 1 OR pos = m)"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("way"),
        F.when(F.col("o_orderstatus") == "O", "residential").when(F.col("o_orderstatus") == "F", "primary").otherwise("footway").alias("highway"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("1", "private", "2", "yes", "3", "no")]), F.substring("o_orderpriority", 1, 1)).alias("access"),
        F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "-1").when(k % 5 == 2, "no").alias("oneway"),
        F.when(k % 7 == 0, "roundabout").alias("junction"))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    """(way, nodes ARRAY<STRUCT<node, cents>>) in line order."""
    line = F.struct("l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    got = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return got.select("way", F.transform("lines", lambda s: F.struct(s["l_partkey"].alias("node"), s["cents"].alias("cents"))).alias("nodes"))


@query("drivable_ways", f"WITH {TAGS} SELECT way, highway, access FROM tags WHERE {DRIVE}")
def drivable_ways(spark, sf):
    return tagged(spark, sf).filter(T.drivable(F.col("highway"), F.col("access"))).select("way", "highway", "access")


@query("travel_permissions", f"WITH {TAGS} SELECT way, NOT (NOT {ONLY} AND coalesce(oneway, '') = '-1') AS fwd, NOT {ONLY} AS rev FROM tags")
def travel_permissions(spark, sf):
    return tagged(spark, sf).select("way", T.travel(F.col("oneway"), F.col("junction")).alias("d")).select("way", "d.fwd", "d.rev")


@query("first_tags", """SELECT o_orderkey AS way, CASE WHEN o_orderkey % 3 = 0 THEN 'amenity' WHEN o_orderkey % 4 = 0 THEN 'shop' WHEN o_orderkey % 5 = 0 THEN 'leisure' END AS key,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'park' END AS value FROM orders""")
def first_tags(spark, sf):
    """Priority of tag keys, whatever order a row's map has them in."""
    k = F.col("o_orderkey")
    tag = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    entries = F.array_compact(F.array(F.when(k % 5 == 0, tag("leisure", F.lit("park"))), F.when(k % 4 == 0, tag("shop", F.col("o_orderpriority"))), F.when(k % 3 == 0, tag("amenity", F.col("o_orderstatus"))), tag("name", F.lit("x"))))
    rows = table(spark, sf, "orders").select(k.alias("way"), F.map_from_entries(entries).alias("tags"))
    return rows.select("way", T.first_tag(F.col("tags"), T.POI_KEYS).alias("t")).select("way", "t.key", "t.value")


@query("junctions", f"WITH {BREAKS} SELECT node, n > 1 AS is_intersection FROM breaks JOIN uses USING (node)")
def junctions(spark, sf):
    return roads.junctions(ways(spark, sf))


SEGMENTS = f"""{BREAKS}, marked AS (SELECT s.*, row_number() OVER (PARTITION BY s.way ORDER BY s.pos) AS k FROM steps s JOIN breaks b USING (node)),
 runs AS (SELECT way, k, pos AS p0, lead(pos) OVER (PARTITION BY way ORDER BY pos) AS p1, node AS a, lead(node) OVER (PARTITION BY way ORDER BY pos) AS b FROM marked),
 segments AS (SELECT way, CAST(k AS BIGINT) AS segment, a, b, CAST(p1 - p0 + 1 AS BIGINT) AS nodes FROM runs WHERE p1 IS NOT NULL)"""


@query("road_segments", f"WITH {SEGMENTS} SELECT * FROM segments")
def road_segments(spark, sf):
    return roads.segments(ways(spark, sf)).select("way", "segment", "a", "b", F.size("path").cast("long").alias("nodes"))


@query("directed_edges", f"""WITH {SEGMENTS}, {TAGS}, dirs AS (SELECT way, NOT (NOT {ONLY} AND coalesce(oneway, '') = '-1') AS fwd, NOT {ONLY} AS rev FROM tags)
 SELECT way || '-' || segment || '-f' AS edge_id, a AS from_node, b AS to_node FROM segments JOIN dirs USING (way) WHERE fwd
 UNION ALL SELECT way || '-' || segment || '-r', b, a FROM segments JOIN dirs USING (way) WHERE rev""")
def directed_edges(spark, sf):
    permitted = tagged(spark, sf).select("way", T.travel(F.col("oneway"), F.col("junction")).alias("travel"))
    return roads.directed(roads.segments(ways(spark, sf)).join(permitted, "way")).select("edge_id", "from_node", "to_node")


@query("layer_filter", """SELECT vec_id, x > 95.0 AND x < 105.0 AND y > 38.0 AND y < 42.0 AS poi_within, x >= 95.0 AND x <= 105.0 AND y >= 38.0 AND y <= 42.0 AS area_meets FROM
 (SELECT vec_id, 100.0 + round(CAST(embedding[1] AS DOUBLE) * 50.0) AS x, 40.0 + round(CAST(embedding[2] AS DOUBLE) * 20.0) AS y FROM embeddings) WHERE x BETWEEN 95.0 AND 105.0 AND y BETWEEN 38.0 AND 42.0""")
def layer_filter(spark, sf):
    """Points must lie strictly inside the study box; other layers only have to meet it."""
    p = table(spark, sf, "embeddings").select("vec_id", (100.0 + F.round(F.col("embedding")[0].cast("double") * 50.0)).alias("x"), (40.0 + F.round(F.col("embedding")[1].cast("double") * 20.0)).alias("y"))
    box = (95.0, 38.0, 105.0, 42.0)
    inside, meets = roads.within(F.col("x"), F.col("y"), box), roads.meets(F.col("x"), F.col("y"), F.col("x"), F.col("y"), box)
    return p.filter(meets).select("vec_id", inside.alias("poi_within"), meets.alias("area_meets"))
