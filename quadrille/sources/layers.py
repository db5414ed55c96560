"""Map layers and graphs as partitioned Parquet, and raw map rows as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import roads

NODE = "id long, lon double, lat double, tags map<string,string>"
WAY = "id long, nodes array<struct<node:long,x:double,y:double>>, tags map<string,string>"
AREA = "id long, geojson string, tags map<string,string>"


def pois(nodes: DataFrame) -> DataFrame:
    """Points of interest: tagged nodes with a valid location."""
    t = T.first_tag(F.col("tags"), T.POI_KEYS)
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return nodes.filter(ok).select(F.lit("node").alias("osm_type"), F.col("id").cast("string").alias("osm_id"), F.element_at("tags", "name").alias("name"), F.element_at("tags", "name:en").alias("name_en"), t.alias("t"), F.col("lon").alias("x"), F.col("lat").alias("y")).filter("t is not null").select("osm_type", "osm_id", "name", "name_en", F.col("t.key").alias("category_key"), F.col("t.value").alias("category"), "x", "y")


def road_ways(ways: DataFrame) -> DataFrame:
    """Drivable ways of two nodes or more with their permitted directions."""
    tag = lambda k: F.element_at("tags", k)
    good = ways.filter((F.size("nodes") >= 2) & T.drivable(tag("highway"), tag("access")))
    return good.select(F.col("id").alias("way"), tag("name").alias("name"), tag("highway").alias("highway"), T.travel(tag("oneway"), tag("junction")).alias("travel"), "nodes")


def areas(rows: DataFrame) -> DataFrame:
    t = T.first_tag(F.col("tags"), T.AOI_KEYS)
    return rows.filter(F.coalesce(F.trim("geojson"), F.lit("")) != "").select(F.col("id").cast("string").alias("osm_id"), F.element_at("tags", "name").alias("name"), t.alias("t"), "geojson").filter("t is not null").select("osm_id", "name", F.col("t.key").alias("category_key"), F.col("t.value").alias("category"), "geojson")


def road_graph(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(junctions, directed edges with cost_m) of road ways whose points are in metres."""
    from ..functions.geometry import line_length

    lines = ways.select("way", "nodes")
    edges = roads.directed(roads.segments(lines).join(ways.select("way", "travel"), "way"))
    pts = F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return roads.junctions(lines), edges.select("edge_id", "way", F.col("from_node").alias("src"), F.col("to_node").alias("dst"), line_length(pts).alias("cost_m"))


def save_layers(layers: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One folder a layer; reading a layer touches that folder only."""
    for name, df in layers.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/layer={name}")


def load_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/layer={name}")


def load_graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph in GraphML, by Spark's XML source.  Attribute keys are returned as they are in the file."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, data array<struct<_key:string,_VALUE:string>>").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_key:string,_VALUE:string>>").load(path)
    pairs = lambda: F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    return nodes.select(F.col("_id").alias("node"), pairs().alias("attributes")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), pairs().alias("attributes"))


def save_graph_xml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Edges as XML rows (part files), the counterpart of ``load_graph_xml``."""
    edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array(F.struct(F.lit("cost_m").alias("_key"), F.col("cost").cast("string").alias("_VALUE"))).alias("data")).write.format("xml").option("rootTag", "graph").option("rowTag", "edge").save(f"{path}/edges")
    nodes.select(F.col("node").cast("string").alias("_id"), F.array(F.struct(F.lit("kind").alias("_key"), F.lit("node").alias("_VALUE"))).alias("data")).write.format("xml").option("rootTag", "graph").option("rowTag", "node").save(f"{path}/nodes")
