"""Polygons: relations, rendered views, anchors, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins, polygon
from .points import BOXES, TOPOLOGY, boxes
from .registry import query, table

NEXT = f"{BOXES}, t AS (SELECT a.id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM boxes a JOIN boxes b ON b.id = a.id + 1)"


def _ring(*c):
    x1, y1, x2, y2 = (F.col(x).cast("string") for x in c)
    p = lambda x, y: F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), p(x1, y1), F.lit(","), p(x2, y1), F.lit(","), p(x2, y2), F.lit(","), p(x1, y2), F.lit(","), p(x1, y1), F.lit("]]}"))


def rectangle_pairs(spark, sf):
    b = boxes(spark, sf)
    l, r = b.toDF(*[f"l_{c}" for c in b.columns]), b.toDF(*[f"r_{c}" for c in b.columns])
    side = lambda s: _ring(*[f"{s}_{c}" for c in ("x1", "y1", "x2", "y2")])
    pairs = l.join(r, F.col("r_id") == F.col("l_id") + 1).select(F.col("l_id").alias("id"), side("l").alias("a"), side("r").alias("b"))
    return _dealt(pairs, "id")


def _dealt(df, key):
    """Spread few rows with much work each over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


FIVE = f"CASE WHEN ax1 = bx1 AND ay1 = by1 AND ax2 = bx2 AND ay2 = by2 THEN 'Contains' ELSE {TOPOLOGY} END"
MATRIX = """CASE WHEN r = 'Disjoint' THEN 'FF2FF1212' WHEN r = 'Touches' AND (least(ax2, bx2) = greatest(ax1, bx1) AND least(ay2, by2) = greatest(ay1, by1)) THEN 'FF2F01212' WHEN r = 'Touches' THEN 'FF2F11212' END"""


@query("polygon_relations", f"WITH {NEXT} SELECT id, {FIVE} AS relation FROM t")
def polygon_relations(spark, sf):
    """Rectangles as polygons: the exact matrix must give what the box rule gives."""
    return rectangle_pairs(spark, sf).select("id", polygon.related(F.col("a"), F.col("b")).alias("r")).select("id", F.col("r.relation5").alias("relation"))


@query("polygon_matrices", f"WITH {NEXT}, n AS (SELECT *, {TOPOLOGY} AS r FROM t) SELECT id, {MATRIX} AS matrix FROM n WHERE r IN ('Disjoint', 'Touches')")
def polygon_matrices(spark, sf):
    """The matrices of pairs whose interiors do not meet."""
    got = rectangle_pairs(spark, sf).select("id", polygon.related(F.col("a"), F.col("b")).alias("r"))
    return got.filter(F.col("r.relation").isin("Disjoint", "Touches")).select("id", F.col("r.de9im").alias("matrix"))


def _blob(key, n: int = 24):
    """A star-shaped polygon of ``n`` corners around a seeded centre, as GeoJSON."""
    import math

    pts = []
    for i in range(n):
        h = F.pmod(F.xxhash64(key, F.lit(i)), F.lit(100))
        rad = 30.0 + h / 10.0
        pts.append(F.concat(F.lit("["), F.round(F.pmod(key * 7, F.lit(200)) + rad * math.cos(2 * math.pi * i / n), 3).cast("string"), F.lit(","), F.round(F.pmod(key * 13, F.lit(150)) + rad * math.sin(2 * math.pi * i / n), 3).cast("string"), F.lit("]")))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *pts, pts[0]), F.lit("]]}"))


@query("simplified_pairs")
def simplified_pairs(spark, sf):
    """Rendered views of polygon pairs, one a supplier: the coarsest that keep label and matrix."""
    k = F.col("s_suppkey")
    rows = _dealt(table(spark, sf, "supplier").select(k.alias("id"), _blob(k).alias("a"), _blob(k + 1).alias("b")), "id")
    v = rows.select("id", polygon.related(F.col("a"), F.col("b")).alias("r"), polygon.simplified_pair(F.col("a"), F.col("b")).alias("s"))
    again = polygon.related(F.col("s.a"), F.col("s.b"))
    return v.withColumn("t", again).select("id", F.col("r.relation").alias("relation"), F.col("s.tolerance").alias("tolerance"), (F.col("t.de9im") == F.col("r.de9im")).alias("kept"))


@query("polygon_anchors", f"WITH {BOXES} SELECT id, CAST(round((x1 + x2) / 2.0 * 1000) AS BIGINT) AS x, CAST(round((y1 + y2) / 2.0 * 1000) AS BIGINT) AS y FROM boxes")
def polygon_anchors(spark, sf):
    b = boxes(spark, sf).select("id", polygon.inner_point(_ring("x1", "y1", "x2", "y2")).alias("p"))
    return b.select("id", F.round(F.col("p.x") * 1000).cast("long").alias("x"), F.round(F.col("p.y") * 1000).cast("long").alias("y"))


@query("line_lengths", """WITH s AS (SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem), d AS (SELECT id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS leg FROM s WINDOW w AS (PARTITION BY id ORDER BY n))
 SELECT id, CAST(count(*) AS BIGINT) AS vertices, CAST(round(coalesce(sum(leg), 0) * 1000) AS BIGINT) AS millimetres FROM d GROUP BY id""")
def line_lengths(spark, sf):
    """Vertices in the order of their numbers, unknown values last; the length is rounded once."""
    order = [c for n in ("l_linenumber", "l_partkey", "l_quantity") for c in (F.col(n).isNull().alias(f"no_{n}"), F.col(n))]
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    pts = F.transform("s", lambda q: F.struct(q["l_quantity"].cast("double").alias("x"), q["l_partkey"].cast("double").alias("y")))
    return rows.select("id", G.vertex_count(F.array(pts)).cast("long").alias("vertices"), F.round(G.line_length(pts, None) * 1000).cast("long").alias("millimetres"))


@query("nearby_polygons", f"""WITH {BOXES}, m AS (SELECT a.id AS l_id, b.id AS r_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM boxes a JOIN boxes b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE a.id < b.id) SELECT l_id, r_id, {FIVE} AS relation FROM m""")
def nearby_polygons(spark, sf):
    """Grid join on bounding boxes first, the exact polygon test on its pairs only."""
    b = boxes(spark, sf)
    pairs = _dealt(joins.grid_join(b, b).filter("l_id < r_id"), "l_id")
    side = lambda s: _ring(*[f"{s}_{c}" for c in ("x1", "y1", "x2", "y2")])
    return pairs.select("l_id", "r_id", polygon.related(side("l"), side("r")).alias("r")).select("l_id", "r_id", F.col("r.relation5").alias("relation"))
