"""Predicates on map tags, manifests and provenance; every one is null-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes that cars may use, and tag keys by priority.
DRIVABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
POI_KEYS = ("amenity", "shop", "tourism", "office", "historic", "leisure", "public_transport")
AOI_KEYS = ("amenity", "building", "landuse", "leisure", "natural", "boundary", "place")
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84", "CRS:84")


def drivable(highway: Column, access: Column) -> Column:
    return F.coalesce(highway.isin(*DRIVABLE), F.lit(False)) & ~F.coalesce(access.isin("no", "private"), F.lit(False))


def travel(oneway: Column, junction: Column) -> Column:
    """STRUCT<fwd, rev>: permitted directions of a way."""
    value = F.lower(F.coalesce(oneway, F.lit("")))
    only = value.isin("yes", "true", "1") | F.coalesce(junction == "roundabout", F.lit(False))
    back = ~only & (value == "-1")
    return F.struct((~back).alias("fwd"), (~only).alias("rev"))


def first_tag(tags: Column, keys) -> Column:
    """STRUCT<key, value> of the first key present; null without any."""
    return F.coalesce(*[F.when(F.map_contains_key(tags, k), F.struct(F.lit(k).alias("key"), F.element_at(tags, k).alias("value"))) for k in keys])


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def provenance_complete(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & filled(c)
    return out


def needs_analysis_crs(crs: Column, analysis_crs: Column) -> Column:
    return F.coalesce(F.upper(crs).isin(*GEOGRAPHIC), F.lit(False)) & ~filled(analysis_crs)


def valid_token(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False))


def valid_bbox(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    return F.coalesce((min_lon < max_lon) & (min_lat < max_lat), F.lit(False))


def bare_name(c: Column) -> Column:
    """A file name without any folder."""
    return filled(c) & ~c.contains("/") & ~c.contains("\\") & ~c.isin(".", "..")


def manifest_violations() -> Column:
    """Ordered reasons why a snapshot manifest row is refused."""
    need = ["provider", "city", "snapshot_id", "source_name", "source_url", "download_date", "source_crs", "license"]
    bbox = [F.get("bbox", i) for i in range(4)]
    checks = [*[(~filled(F.col(c)), f"blank {c}") for c in need],
              *[(~valid_token(F.col(c)), f"bad token {c}") for c in ("provider", "city", "snapshot_id")],
              ((F.size("bbox") != 4) | ~valid_bbox(*bbox), "bad bbox"),
              (F.coalesce(F.size("files"), F.lit(0)) < 1, "no files"),
              (F.exists("files", lambda f: ~bare_name(f)), "file name with folder")]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks]))


def url_basename(url: Column) -> Column:
    return F.substring_index(F.parse_url(url, F.lit("PATH")), "/", -1)


def valid_point(coordinates: Column) -> Column:
    return F.coalesce(F.size(coordinates) == 2, F.lit(False)) & F.coalesce(~F.exists(coordinates, lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def valid_geojson(text: Column) -> Column:
    """An object with a type and coordinates."""
    parts = F.from_json(text, "type string, coordinates string")
    return F.coalesce(F.try_parse_json(text).isNotNull() & parts["type"].isNotNull() & parts["coordinates"].isNotNull(), F.lit(False))


def edges_declared(nodes: Column, edges: Column, source: Column, target: Column) -> Column:
    """Every edge is a pair of declared nodes; so are both ends of the query."""
    return F.coalesce(F.forall(edges, lambda e: (F.size(e) == 2) & F.forall(e, lambda v: F.array_contains(nodes, v))) & F.array_contains(nodes, source) & F.array_contains(nodes, target), F.lit(False))
