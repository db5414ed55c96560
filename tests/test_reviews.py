import json

from pyspark.sql import functions as F

from quadrille.functions import tags as T
from quadrille.operators import graph, sampling
from quadrille.sources import reviews


def test_package_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "k", "q?", {"ooda": "a", "qa": "b"}), ("s2", "k", "q?", {"qa": "b"})], reviews.RECORD)
    reviews.write_package(rows, str(tmp_path / "p"), "b1")
    assert [r["scenario_id"] for r in reviews.read_package(spark, str(tmp_path / "p")).collect()] == ["s1"]
    (tmp_path / "l.json").write_text('{"scenario_id":"s1","verdict":"approved"}\n')
    assert reviews.read_labels(spark, str(tmp_path / "l.json")).first()["verdict"] == "approved"


def test_manifest_and_card(spark):
    counts = spark.createDataFrame([("train", 3), ("test", 1)], "split string, n long")
    m = json.loads(reviews.manifest_json(counts, ["split"], schema_version="v1"))
    assert m == {"counts": {"test": 1, "train": 3}, "schema_version": "v1", "total": 4}
    assert "| train | 3 |" in reviews.dataset_card("x", {"train": 3}, "ODbL")


def test_held_out(spark):
    ok = [("user", "q"), ("assistant", "a")]
    rows = [("c-location_direction-1", "test", "ooda", ok), ("c-other-2", "test", "ooda", ok), ("c-object_topology-3", "test", "ooda", ok[:1]), ("c-object_topology-4", "test", "ooda", ok), ("c-object_topology-4", "test", "ooda", ok), ("c-object_topology-5", "train", "ooda", ok)]
    df = spark.createDataFrame(rows, "scenario_id string, split string, style string, messages array<struct<role:string,content:string>>")
    got = sorted((r["scenario_id"], r["problems"]) for r in reviews.held_out(df).collect())
    assert got == [("c-location_direction-1", []), ("c-object_topology-3", ["messages"]), ("c-object_topology-4", ["duplicate"]), ("c-object_topology-4", ["duplicate"]), ("c-other-2", ["task"])]


def test_path_edges_and_alternation(spark):
    edges = spark.createDataFrame([("a", "b", 2, "e1"), ("a", "b", 1, "e2"), ("b", "c", 1, "e3")], "src string, dst string, cost int, edge_id string")
    paths = spark.createDataFrame([(1, ["a", "b", "c"])], "k int, path array<string>")
    assert graph.path_edges(paths, edges, ["k"]).first()["edge_ids"] == ["e2", "e3"]
    rows = spark.range(10).withColumn("yes", F.col("id") % 3 == 0)
    assert [r["yes"] for r in sampling.alternate(rows, "yes", ["id"], 5).collect()] == [True, False, True, False, True]


def test_shapes_of_inputs(spark):
    r = spark.range(1).select(T.valid_point(F.array(F.lit(1.0), F.lit(2.0))), T.valid_point(F.array(F.lit(1.0))), T.valid_geojson(F.lit('{"type":"Point","coordinates":[1,2]}')), T.valid_geojson(F.lit('{"type":"Point"}')),
                              T.edges_declared(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("a"), F.lit("b"))), F.lit("a"), F.lit("b")), T.edges_declared(F.array(F.lit("a")), F.array(F.array(F.lit("a"), F.lit("b"))), F.lit("a"), F.lit("a"))).first()
    assert tuple(r) == (True, False, True, False, True, False)


def test_evaluation_report_is_written(spark, tmp_path):
    import json

    import pytest

    from quadrille.sources import reviews as reports

    scores = spark.createDataFrame([("s1", "a", True), ("s2", "a", False), ("s3", "b", None)], "scenario_id string, task string, act_exact boolean")
    path = f"{tmp_path}/out"
    reports.write_evaluation(scores, path, ["act_exact"], condition="base")
    report = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/report").collect()))
    assert report == {"condition": "base", "records": 3, "errors": 2, "rates": {"act_exact": 0.333333}, "error_ids": ["s2", "s3"]}
    assert spark.read.json(f"{path}/predictions").count() == 3 and sorted(r["scenario_id"] for r in spark.read.json(f"{path}/errors").collect()) == ["s2", "s3"]
    with pytest.raises(Exception, match="exists"):
        reports.write_evaluation(scores, path, ["act_exact"])
    reports.write_evaluation(scores.limit(0), path, ["act_exact"], overwrite=True)


def test_token_ids_of_any_shape(spark):
    import pytest

    from quadrille.operators import evaluation as E

    df = spark.sql("select named_struct('input_ids', array(1, 2)) a, array(array(1), array(), array(2, 3)) b, array(5) c, map('input_ids', array(7)) d, 'x' e, array(array(array(1))) f, cast(null as array<int>) g")
    got = df.select(*[E.flat_ids(df, c).alias(c) for c in "abcdg"]).first()
    assert tuple(got) == ([1, 2], [1, 2, 3], [5], [7], None)
    for bad in "ef":
        with pytest.raises(TypeError):
            E.flat_ids(df, bad)
