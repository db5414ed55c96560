"""Point pairs and boxes: truth, blocks, splits, balanced samples, spatial join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins, sampling, splits
from .registry import query, table

POINTS = "points AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 100000.0, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 100000.0, 3) AS y FROM embeddings)"
PAIRS = f"{POINTS}, pairs AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, b.x - a.x AS dx, b.y - a.y AS dy FROM points a JOIN points b ON b.vec_id = a.vec_id + 1)"
BEARING = "CASE WHEN dx = 0 AND dy = 0 THEN NULL ELSE (['E','NE','N','NW','W','SW','S','SE'])[CAST(floor((((degrees(atan2(dy, dx)) + 360.0) % 360.0) + 22.5) / 45.0) AS INTEGER) % 8 + 1] END"
SIGN = "nullif(CASE WHEN dy > 0 THEN 'N' WHEN dy < 0 THEN 'S' ELSE '' END || CASE WHEN dx > 0 THEN 'E' WHEN dx < 0 THEN 'W' ELSE '' END, '')"
BLOCK = "CAST(CAST(floor(({x}) / 2000.0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(({y}) / 2000.0) AS BIGINT) AS VARCHAR)"
BOXES = "boxes AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS BIGINT) AS x1, CAST(p_partkey // 10 AS BIGINT) AS y1, CAST(p_partkey % 97 + 1 + p_size % 7 AS BIGINT) AS x2, CAST(p_partkey // 10 + 1 + p_size % 5 AS BIGINT) AS y2 FROM part)"
TOPOLOGY = """CASE WHEN ax1 <= bx1 AND ay1 <= by1 AND ax2 >= bx2 AND ay2 >= by2 THEN 'Contains' WHEN bx1 <= ax1 AND by1 <= ay1 AND bx2 >= ax2 AND by2 >= ay2 THEN 'Within'
 WHEN least(ax2, bx2) < greatest(ax1, bx1) OR least(ay2, by2) < greatest(ay1, by1) THEN 'Disjoint'
 WHEN least(ax2, bx2) = greatest(ax1, bx1) OR least(ay2, by2) = greatest(ay1, by1) THEN 'Touches' ELSE 'Intersects' END"""
MEETS = f"{BOXES}, meets AS (SELECT a.id AS l_id, b.id AS r_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM boxes a JOIN boxes b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE a.id <> b.id)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 100000.0, 3)
    return table(spark, sf, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = points(spark, sf).toDF("a_id", "ax", "ay")
    b = points(spark, sf).toDF("b_id", "bx", "by")
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in rows of ten: the area grows with the table, so the density does not."""
    k, s = F.col("p_partkey"), F.col("p_size")
    y = F.floor(k / 10).cast("long")
    return table(spark, sf, "part").select(k.alias("id"), (k % 97).alias("x1"), y.alias("y1"), (k % 97 + 1 + s % 7).alias("x2"), (y + 1 + s % 5).alias("y2"))




@query("bearing_counts", f"WITH {PAIRS} SELECT {BEARING} AS direction, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 1")
def bearing_counts(spark, sf):
    return pairs(spark, sf).groupBy(G.bearing8(F.col("dx"), F.col("dy")).alias("direction")).agg(F.count("*").alias("n"))


@query("point_distances", f"WITH {PAIRS} SELECT a_id, b_id, CAST(round(sqrt(dx * dx + dy * dy) * 1000) AS BIGINT) AS millimetres FROM pairs")
def point_distances(spark, sf):
    return pairs(spark, sf).select("a_id", "b_id", F.round(G.distance(F.col("dx"), F.col("dy")) * 1000).cast("long").alias("millimetres"))


@query("sign_directions", f"WITH {PAIRS} SELECT a_id, {SIGN} AS direction, {BEARING} AS bearing, {SIGN} = {BEARING} AS same FROM pairs")
def sign_directions(spark, sf):
    s, b = G.sign_direction(F.col("dx"), F.col("dy")), G.bearing8(F.col("dx"), F.col("dy"))
    return pairs(spark, sf).select("a_id", s.alias("direction"), b.alias("bearing"), (s == b).alias("same"))


@query("spatial_blocks", f"WITH {POINTS} SELECT {BLOCK.format(x='x', y='y')} AS block, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1")
def spatial_blocks(spark, sf):
    return points(spark, sf).groupBy(G.spatial_block(F.col("x"), F.col("y")).alias("block")).agg(F.count("*").alias("n"))


@query("distance_band", f"WITH {PAIRS} SELECT a_id, b_id, {BEARING} AS direction FROM pairs WHERE sqrt(dx * dx + dy * dy) BETWEEN 25 AND 15000")
def distance_band(spark, sf):
    return pairs(spark, sf).filter(F.hypot("dx", "dy").between(25, 15000)).select("a_id", "b_id", G.bearing8(F.col("dx"), F.col("dy")).alias("direction"))


SAMPLED = f"""WITH {POINTS}, keyed AS (SELECT vec_id, x, y, md5('7:' || vec_id) AS h FROM points),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, vec_id) AS n FROM keyed),
 cand AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, b.x - a.x AS dx, b.y - a.y AS dy FROM ordered a JOIN ordered b ON substr(a.h, 1, 2) = substr(b.h, 1, 2) AND b.n = a.n + 1)
 SELECT a_id, b_id, CAST(round(sqrt(dx * dx + dy * dy) * 1000) AS BIGINT) AS millimetres FROM cand WHERE sqrt(dx * dx + dy * dy) BETWEEN 25 AND 15000"""


@query("seeded_pairs", SAMPLED)
def seeded_pairs(spark, sf):
    """Random pairs without replacement: neighbours in seeded order inside hash buckets, so no global sort is needed."""
    keyed = points(spark, sf).withColumn("h", sampling.seeded(7, F.col("vec_id")))
    keyed = sampling.round_robin(keyed.withColumn("bucket", F.substring("h", 1, 2)), "bucket", ["h", "vec_id"], "n")
    a = keyed.select("bucket", "n", F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = keyed.select("bucket", (F.col("n") - 1).alias("n"), F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return a.join(b, ["bucket", "n"]).filter(d.between(25, 15000)).select("a_id", "b_id", F.round(F.round(d, 3) * 1000).cast("long").alias("millimetres"))


@query("box_join", f"WITH {MEETS} SELECT l_id, r_id, {TOPOLOGY} AS relation FROM meets")
def box_join(spark, sf):
    b = boxes(spark, sf)
    a, o = [tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")) for s in ("l", "r")]
    return joins.grid_join(b, b).filter("l_id <> r_id").select("l_id", "r_id", G.box_topology(a, o).alias("relation"))


@query("box_topology_counts", f"""WITH {BOXES}, shifted AS (SELECT a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM boxes a JOIN boxes b ON b.id = a.id + 1)
 SELECT {TOPOLOGY} AS relation, CAST(count(*) AS BIGINT) AS n FROM shifted GROUP BY 1""")
def box_topology_counts(spark, sf):
    b = boxes(spark, sf)
    l, r = b.toDF(*[f"l_{c}" for c in b.columns]), b.toDF(*[f"r_{c}" for c in b.columns])
    a, o = [tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")) for s in ("l", "r")]
    return l.join(r, F.col("r_id") == F.col("l_id") + 1).groupBy(G.box_topology(a, o).alias("relation")).agg(F.count("*").alias("n"))


BALANCED = f"""WITH {MEETS}, named AS (SELECT l_id, r_id, {TOPOLOGY} AS relation FROM meets), ranked AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('11:' || l_id || ':' || r_id), l_id, r_id) AS turn FROM named)
 SELECT l_id, r_id, relation, CAST(turn AS BIGINT) AS turn FROM ranked WHERE turn <= 20"""


@query("balanced_relations", BALANCED)
def balanced_relations(spark, sf):
    """Twenty pairs of each relation in seeded order: the quota is the operator's own."""
    found = box_join(spark, sf)
    keyed = sampling.round_robin(found, "relation", [sampling.seeded(11, F.col("l_id"), F.col("r_id")), "l_id", "r_id"])
    return keyed.filter("turn <= 20").select("l_id", "r_id", "relation", F.col("turn").cast("long"))


@query("box_neighbours", f"WITH {MEETS}, ranked AS (SELECT l_id, r_id, row_number() OVER (PARTITION BY l_id ORDER BY md5('3:' || l_id || ':' || r_id), r_id) AS n FROM meets) SELECT l_id, r_id FROM ranked WHERE n <= 20")
def box_neighbours(spark, sf):
    b = boxes(spark, sf)
    return joins.neighbours(joins.grid_join(b, b), 20, [sampling.seeded(3, F.col("l_id"), F.col("r_id")), "r_id"]).select("l_id", "r_id")


CRC = """RECURSIVE {src}, keys AS (SELECT DISTINCT block, '20260920:' || block AS s FROM rows), crc AS (
 SELECT block, s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM keys
 UNION ALL
 SELECT block, s, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(substr(s, i, 1)) AS BIGINT)), [CAST(0 AS BIGINT) FOR q IN range(8)]), lambda acc, q: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, CAST(3988292384 AS BIGINT)) ELSE acc // 2 END) FROM crc WHERE i <= length(s)),
 units AS (SELECT block, xor(c, CAST(4294967295 AS BIGINT)) / 4294967296.0 AS u FROM crc WHERE i = length(s) + 1)"""
SPLIT = "CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'validation' ELSE 'test' END"


@query("block_split", "WITH " + CRC.format(src=f"{PAIRS}, rows AS (SELECT a_id, {BLOCK.format(x='(ax + bx) / 2', y='(ay + b_y) / 2')} AS block FROM pairs)") + f" SELECT a_id, block, {SPLIT} AS split, 'in_city_spatial_block' AS reason FROM rows JOIN units USING (block)")
def block_split(spark, sf):
    block = G.spatial_block((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    return pairs(spark, sf).select("a_id", block.alias("block")).select("a_id", "block", splits.block_split(F.col("block")).alias("split"), F.lit("in_city_spatial_block").alias("reason"))


@query("split_leaks", "WITH " + CRC.format(src=f"{PAIRS}, rows AS (SELECT a_id, b_id, {BLOCK.format(x='(ax + bx) / 2', y='(ay + b_y) / 2')} AS block FROM pairs)") + f""", named AS (SELECT a_id, b_id, {SPLIT} AS split FROM rows JOIN units USING (block)),
 ends AS (SELECT a_id AS entity, split FROM named UNION ALL SELECT b_id, split FROM named) SELECT entity, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM ends GROUP BY entity HAVING count(DISTINCT split) > 1""")
def split_leaks(spark, sf):
    """Audit: entities that occur in more than one split (blocks are disjoint, entities need not be)."""
    block = G.spatial_block((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    named = pairs(spark, sf).withColumn("split", splits.block_split(block))
    ends = named.select(F.explode(F.array("a_id", "b_id")).alias("entity"), "split")
    return splits.leaks(ends, "entity").select("entity", F.array_join("splits", ",").alias("splits"))


def _sql_utm() -> str:
    import math

    n, radius, series = G.krueger()
    e = 2 * math.sqrt(n) / (1 + n)
    x = " + ".join(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(series, 1))
    y = " + ".join(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(series, 1))
    return f"""WITH {POINTS}, ll AS (SELECT vec_id, 116.0 + x / 100000.0 AS lon, 40.0 + y / 100000.0 AS lat FROM points),
 a AS (SELECT vec_id, sin(radians(lat)) AS s, radians(lon - 117) AS lam FROM ll), b AS (SELECT vec_id, lam, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM a),
 c AS (SELECT vec_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
 SELECT vec_id, CAST(round((500000.0 + {0.9996 * radius!r} * (eta + {x})) * 100) AS BIGINT) AS east_cm, CAST(round({0.9996 * radius!r} * (xi + {y}) * 100) AS BIGINT) AS north_cm FROM c"""


@query("utm_projection", _sql_utm())
def utm_projection(spark, sf):
    p = points(spark, sf)
    east, north = G.utm(116.0 + F.col("x") / 100000.0, 40.0 + F.col("y") / 100000.0, 50)
    return p.select("vec_id", F.round(east * 100).cast("long").alias("east_cm"), F.round(north * 100).cast("long").alias("north_cm"))
