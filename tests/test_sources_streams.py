import json

import pandas as pd
import pytest

from pyspark.sql import functions as F

from quadrille.operators import joins, records
from quadrille.sources import jsonl, layers, snapshots
from quadrille.streaming import decisions, windows


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "é", 1.5, None), ("b", "x", 2.0, "s")], "split string, t string, v double, n string")
    path = str(tmp_path / "out")
    assert jsonl.write(df, path, by=["split"]) == 2
    with pytest.raises(Exception):
        jsonl.write(df, path)
    back = spark.read.json(path).select("split", "t", "v", "n")
    assert sorted(map(tuple, back.collect())) == [("a", "é", 1.5, None), ("b", "x", 2.0, "s")]
    assert jsonl.publish(df.filter("split = 'a'"), path) == 1 and spark.read.text(path).count() == 1
    assert jsonl.archive_then_replace(spark, df.filter("split = 'a'"), df, path, str(tmp_path / "old")) == (1, 2)


def test_numbered_and_strict_reading(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a"}\n\n{"id":"b"}\nnot json\n{"id":"c"}\n')
    rows = {r["line"]: r for r in jsonl.read_numbered(spark, str(p), "id string").collect()}
    assert {k: (r["value"] and r["value"]["id"], r["error"]) for k, r in rows.items()} == {1: ("a", None), 3: ("b", None), 4: (None, "line 4: not a JSON object"), 5: ("c", None)}
    got = jsonl.read(spark, str(p), "id string").collect()
    assert sum(r["_corrupt_record"] is not None for r in got) == 1 and len(got) == 4
    with pytest.raises(Exception):
        jsonl.read(spark, str(p), "id string", strict=True).collect()
    good, bad = jsonl.validated(spark.createDataFrame([("a",), (" ",), (None,)], "id string"), [(F.trim("id") != "", "blank id")])
    assert good.count() == 1 and [r["problems"] for r in bad.collect()] == [["blank id"]] * 2


def manifest(**k):
    return snapshots.Manifest(**{**dict(provider="osm", city="x", snapshot_id="s1", source_name="n", source_url="u", download_date="2026-01-01", source_crs="EPSG:4326", license="ODbL", bbox=[1.0, 2.0, 3.0, 4.0]), **k})


def test_snapshots(spark, tmp_path):
    src = tmp_path / "a.pbf"
    src.write_bytes(b"data")
    at = snapshots.register(spark, tmp_path / "raw", manifest(), src)
    assert (at / "a.pbf").read_bytes() == b"data" and json.loads((at / "manifest.json").read_text())["files"] == ["a.pbf"]
    with pytest.raises(FileExistsError):
        snapshots.register(spark, tmp_path / "raw", manifest(), src)
    for bad in (manifest(bbox=[3.0, 2.0, 1.0, 4.0]), manifest(license=" "), manifest(city="Bad City")):
        with pytest.raises(ValueError):
            snapshots.register(spark, tmp_path / "other", bad, src)
    assert not list((tmp_path / "other").rglob("*.json"))
    assert snapshots.load(spark, str(at / "manifest.json")).first()["problems"] == []
    got = snapshots.download(spark, tmp_path / "raw", manifest(snapshot_id="s2"), src.as_uri())
    assert (got / "a.pbf").exists()


def test_layers_and_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1.0, 2.0, {"shop": "x", "name": "n"}), (2, 500.0, 2.0, {"shop": "x"}), (3, 1.0, 2.0, {"z": "x"})], layers.NODE)
    assert [r["osm_id"] for r in layers.pois(nodes).collect()] == ["1"]
    ways = spark.createDataFrame([(7, [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 8.0)], {"highway": "road", "oneway": "yes"}), (8, [(2, 3.0, 4.0), (4, 3.0, 5.0)], {"highway": "road"}), (9, [(1, 0.0, 0.0)], {"highway": "road"})], layers.WAY)
    junctions, edges = layers.road_graph(layers.road_ways(ways))
    assert sorted((r["src"], r["dst"], r["cost_m"]) for r in edges.collect()) == [(1, 2, 5.0), (2, 3, 4.0), (2, 4, 1.0), (4, 2, 1.0)]
    assert {r["node"] for r in junctions.collect() if r["is_intersection"]} == {2}
    layers.save_layers({"edges": edges}, str(tmp_path / "map"))
    assert layers.load_layer(spark, str(tmp_path / "map"), "edges").count() == 4
    xml = tmp_path / "g.graphml"
    xml.write_text('<graphml><graph><node id="n1"><data key="d0">1</data></node><node id="n2"/><edge source="n1" target="n2"><data key="c">2.5</data></edge></graph></graphml>')
    n, e = layers.load_graph_xml(spark, str(xml))
    assert sorted(r["node"] for r in n.collect()) == ["n1", "n2"] and e.first()["attributes"] == {"c": "2.5"}


def test_streaming_windows_equal_batch(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    batch = {tuple(r) for r in windows.tumbling(spark.read.parquet(path)).select("start", "event_type", "n").collect()}
    (tmp_path / "in").mkdir()
    spark.read.parquet(path).write.parquet(str(tmp_path / "in" / "events"))
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(str(tmp_path / "in" / "events"))
    q = windows.tumbling(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select start, event_type, n from w").collect()} == batch


def test_stateful_loop(spark, tmp_path):
    rows = [("a", 1, "SE"), ("a", 2, "SE"), ("b", 1, "N"), ("c", 1, "up"), ("d", 1, "E"), ("d", 2, "NONE"), ("e", 1, "S"), ("e", 2, "E")]
    src = tmp_path / "m"
    spark.createDataFrame(rows, "session string, seq long, move string").write.parquet(str(src))
    stream = spark.readStream.schema("session string, seq long, move string").parquet(str(src))
    q = decisions.decide(stream, 5, (0, 0), (2, 2), {(1, 2)}).writeStream.outputMode("update").format("memory").queryName("loop").start()
    q.processAllAvailable()
    q.stop()
    got = {r["session"]: (r["row"], r["col"], r["status"]) for r in spark.sql("select * from loop").collect()}
    assert got == {"a": (2, 2, "goal"), "b": (0, 0, "outside"), "c": (0, 0, "invalid"), "d": (0, 1, "NONE"), "e": (1, 1, "open")}


def test_append_scored(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = decisions.append_scored(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.withColumn("ok", F.col("id") > 2)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).filter("ok").count() == 2


def test_retries():
    seen = []

    def render(item):
        seen.append(item["attempt"])
        if item["n"] == 2:
            raise ValueError("never")
        return {"n": item["n"], "attempt": item["attempt"]}

    def check(item, result):
        if result["n"] == 1 and result["attempt"] < 2:
            raise ValueError("again")

    pdf = pd.DataFrame({"id": ["a", "b", "c"], "payload": ['{"n":0}', '{"n":1}', '{"n":2}']})
    (out,) = decisions.retried(render, check)(iter([pdf]))
    assert out["attempts"].tolist() == [1, 2, 3] and out["error"].tolist()[2] == "never" and out["result"].tolist()[2] is None


def test_guarded_joins(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    r = spark.createDataFrame([(1, "x")], "k int, w string")
    with pytest.raises(Exception, match="no match"):
        joins.must_match(l, r, "k").collect()
    with pytest.raises(ValueError):
        records.replace_checked(l, r.withColumnRenamed("w", "v"), "k", l)
    salted = joins.skew_salted(l, r, "k", 4, F.col("v"))
    assert [tuple(x) for x in salted.select("k", "v", "w").collect()] == [(1, "a", "x")]
    wide = spark.createDataFrame([("s", "qa", "1")], "scenario_id string, style string, content string")
    with pytest.raises(Exception, match="no ooda"):
        records.styles_by_scenario(wide, ["qa", "ooda"], "ooda").collect()
