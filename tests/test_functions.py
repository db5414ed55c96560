import math

import pytest

from pyspark.sql import functions as F

from quadrille.functions import geometry as G
from quadrille.functions import rewards as R
from quadrille.functions import tags as T
from quadrille.functions import text as X
from quadrille.functions import verify as V
from quadrille.operators import actions, graph, masks, roads, scoring, splits
from quadrille.operators.grid import best_moves


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_directions(spark):
    for dx, dy, angular, sign in [(1, 0, "E", "E"), (1, 1, "NE", "NE"), (0, -1, "S", "S"), (10, 1, "E", "NE"), (-1, 0, "W", "W"), (-3, -3, "SW", "SW"), (0, 0, None, None), (1, -5, "S", "SE")]:
        x, y = F.lit(float(dx)), F.lit(float(dy))
        assert tuple(one(spark, G.bearing8(x, y), G.sign_direction(x, y))) == (angular, sign)
    opposite = {"N": "S", "S": "N", "E": "W", "W": "E", "NE": "SW", "SW": "NE", "NW": "SE", "SE": "NW"}
    for k in range(16):
        a = 2 * math.pi * k / 16 + 0.01
        r = one(spark, G.bearing8(F.lit(math.cos(a)), F.lit(math.sin(a))), G.bearing8(F.lit(-math.cos(a)), F.lit(-math.sin(a))))
        assert opposite[r[0]] == r[1]
    assert tuple(one(spark, G.grid_direction(F.lit(-1), F.lit(0)), G.grid_direction(F.lit(2), F.lit(0)), G.compass_word(F.lit("SW")), G.distance(F.lit(3.333), F.lit(4.444)))) == ("N", None, "southwest", 5.555)


def test_utm_matches_published_points(spark):
    # the central meridian has easting 500 km; northing at the equator is zero
    e, n = G.utm(F.lit(117.0), F.lit(0.0), 50)
    assert tuple(one(spark, F.round(e, 3), F.round(n, 3))) == (500000.0, 0.0)
    e, n = G.utm(F.lit(3.0 + 1e-9), F.lit(45.0), 31)
    r = one(spark, e, n)
    assert abs(r[0] - 500000) < 0.01 and abs(r[1] - 4982950.400) < 0.01


def test_tags(spark):
    for highway, access, ok in [("residential", None, True), ("footway", None, False), ("residential", "private", False), (None, None, False), ("service", "yes", True)]:
        assert one(spark, T.drivable(F.lit(highway).cast("string"), F.lit(access).cast("string")))[0] is ok
    for oneway, junction, want in [("yes", None, (True, False)), ("-1", None, (False, True)), (None, "roundabout", (True, False)), (None, None, (True, True)), ("TRUE", None, (True, False)), ("no", None, (True, True))]:
        assert tuple(one(spark, T.travel(F.lit(oneway).cast("string"), F.lit(junction).cast("string")))[0]) == want
    assert one(spark, T.valid_bbox(*map(F.lit, (116.4, 39.9, 116.3, 40.0))), T.valid_bbox(*map(F.lit, (2, 3, 1, 4))), T.valid_bbox(*map(F.lit, (1, 2, 3, 4))))[:] == (False, False, True)
    assert one(spark, T.needs_analysis_crs(F.lit("epsg:4326"), F.lit(None).cast("string")), T.provenance_complete(F.lit("x"), F.lit(" ")), T.url_basename(F.lit("https://a.b/c/d.pbf?x=1")))[:] == (True, False, "d.pbf")


DONE = "Observe: a\nOrient: b\nDecide: c\nAct: Output east."


def test_rewards_and_answers(spark):
    for text, total in [(DONE, 1.4), (DONE.replace("east", "west"), -0.6), ("east", -1.8)]:
        assert one(spark, R.flat_reward(F.lit(text), F.lit("East")))[0] == total
    assert one(spark, R.format_reward(F.lit("Orient: b\nObserve: a\nDecide: c\nAct: d")), R.format_reward(F.lit("Observe:\nOrient: x")))[:] == (0.3, 0.0)
    cases = {DONE: "east", "no heading\nlast line.": "last line", "Act: the answer is 5.": "5", "ACT : Output (1, 2)": "(1, 2)", "": ""}
    for text, want in cases.items():
        assert one(spark, X.extract_answer(F.lit(text)))[0] == want
    assert one(spark, X.normalize_answer(F.lit("  North\t East!. ")))[0] == "north east"
    for a in ("STRASSE", "straße", "ΣΊΣΥΦΟΣ", "ſo ﬁne", "İx", "ŉ", "ÀÉ"):
        assert one(spark, X.normalize_answer(F.lit(a)))[0] == a.casefold()


def test_final_acts(spark):
    cases = {'Act: {"a":1}': ('{"a":1}', None, True), 'Act: {"a":1}\nmore': ('{"a":1}', "non-whitespace text follows Act JSON", False), "none": (None, "missing Act heading", False), "Act: [1]": (None, "Act JSON must be an object", False), "Act: [1] x": (None, "Act JSON must be an object", False), "Act: 5 x": (None, "Act JSON must be an object", False), 'Act: {"a":': (None, "invalid Act JSON", False), "Act: {a}": (None, "invalid Act JSON", False), 'Act: {"p":{"q":["}"]}} }': ('{"p":{"q":["}"]}}', "non-whitespace text follows Act JSON", False), 'Act: x\nAct: {"a":2} \n': ('{"a":2}', None, True)}
    for text, want in cases.items():
        assert tuple(one(spark, X.final_act(F.lit(text)))[0]) == want
    nested = 'Act: {"path":["a"],"b":{"c":1}}'
    assert tuple(spark.createDataFrame([(nested,)], "t string").select(X.final_act_nested(X.act_remainder(F.col("t"))).alias("f")).first()["f"]) == (nested[5:], None, True)
    assert one(spark, X.stages_in_order(F.lit("Observe: a\nOrient: b\nDecide: c\n" + nested)))[0] is True
    ordered = 'Observe: a\nOrient: b\nDecide: c\nAct: {"x":1}'
    assert one(spark, X.stages_in_order(F.lit(ordered)), X.stages_in_order(F.lit(ordered + "!")), X.stages_in_order(F.lit("Observe: z\n" + ordered)))[:] == (True, False, False)
    assert one(spark, X.json_action(F.lit('Act: do {"operation":"move"} now')))[0] == '{"operation":"move"}'


def test_text_guards(spark):
    r = one(spark, X.symbolic_compass(F.lit("p2 lies to the S of p1")), X.symbolic_compass(F.lit("p2 is south of p1")), X.relabels_cost(F.lit("total length and cost")), X.relabels_cost(F.lit("the cost is least")), X.says_unreachable(F.lit("n1 does not lead to n2")), X.says_unreachable(F.lit("there is no legal directed path")), X.says_unreachable(F.lit("n1 leads to n2")))
    assert r[:] == (True, False, True, False, True, True, False)
    assert one(spark, X.metres(F.lit(1234567.5)), X.metres(F.lit(-0.25)), X.metres(F.lit(0.0)))[:] == ("1234567.500", "-0.250", "0.000")


def test_answer_matching(spark):
    for a, b, want in [('{"d":1.0004}', '{"d":1.0}', True), ('{"d":1.01}', '{"d":1.0}', False), ('{"d":"N"}', '{"d":"N"}', True), ('{"d":"N","e":1}', '{"d":"N"}', False), ("x", '{"d":1}', False), ('{"d":"3"}', '{"d":3}', False), ('{"d":"true"}', '{"d":true}', False), ('{"d":1}', '{"d":true}', False), ('{"p":["a","b"],"c":2.0004}', '{"c":2,"p":["a","b"]}', True), ('{"p":["b","a"]}', '{"p":["a","b"]}', False), ('{"p":[1,[2.0005]]}', '{"p":[1,[2]]}', True), ('{"p":{"x":1.1}}', '{"p":{"x":1}}', False), ('{"p":[]}', '{"p":{}}', False), ('{"p":null}', '{"p":null}', False)]:
        assert one(spark, V.answer_matches(F.lit(a), F.lit(b)))[0] is want


def test_best_paths_have_no_cap(spark):
    """A cheap detour of many hops is the optimum; all ranks equal a full enumeration."""
    chain = [(i, i + 1, 1) for i in range(9)] + [(0, 9, 50), (0, 5, 5), (5, 0, 1), (3, 1, 0), (2, 9, 8)]
    e = spark.createDataFrame(chain, "src int, dst int, cost int")
    got = {(r["src"], r["dst"], r["rank"]): (r["cost"], list(r["path"])) for r in graph.best_paths(e, 2).collect()}
    assert got[0, 9, 1] == (9, [0, 5, 6, 7, 8, 9]) and got[0, 9, 2][0] == 9
    every = {(r["src"], r["dst"], r["rank"]): (r["cost"], list(r["path"])) for r in graph.k_best(graph.simple_paths(e, 9), 2).collect()}
    assert got == every
    near = {(r["src"], r["dst"]) for r in graph.within(e, 2).collect()}
    assert near == {(r["src"], r["dst"]) for r in graph.simple_paths(e, 2).collect()}
    assert graph.best_paths(e.filter("cost > 99"), 2).count() == 0


def test_graph_facts(spark):
    e = spark.createDataFrame([("n1", "n2", 3), ("n2", "n4", 3), ("n1", "n3", 2), ("n3", "n4", 2), ("n4", "n1", 9), ("n1", "n2", 5)], "src string, dst string, cost int")
    cost = {(r["src"], r["dst"]): r["cost"] for r in graph.shortest_costs(e).collect()}
    assert cost["n1", "n4"] == 4 and cost["n1", "n1"] == 13
    q = {(r["src"], r["dst"]): r for r in graph.choose_queries(graph.simple_paths(graph.collapse_parallel(e, ["cost"]).select("src", "dst", "cost"), 3)).collect()}
    assert (q["n1", "n4"]["path"], q["n1", "n4"]["cost"], q["n1", "n4"]["runner_up_cost"]) == (["n1", "n3", "n4"], 4, 6)
    assert graph._first_path([("A", "B"), ("B", "C"), ("D", "E")], "A", "E") is None and graph._first_path([("A", "B")], "A", "A") == ["A"]
    empty = e.filter("cost > 99")
    assert graph.closure(empty).count() == graph.shortest_costs(empty).count() == 0


def test_loop_way_has_an_intersection_at_its_closing_node(spark):
    w = spark.createDataFrame([(1, [(5,), (6,), (7,), (5,)]), (2, [(6,), (8,)])], "way int, nodes array<struct<node:int>>")
    assert {r["node"]: r["is_intersection"] for r in roads.junctions(w).collect()} == {5: True, 6: True, 8: False}
    assert sorted((r["way"], r["a"], r["b"]) for r in roads.segments(w).collect()) == [(1, 5, 6), (1, 6, 5), (2, 6, 8)]


def test_scores_summary(spark):
    s = spark.createDataFrame([("a", True), ("b", False), ("b", None)], "task string, ok boolean")
    got = {(r["scope"], r["name"]): r["ok"] for r in scoring.summary(s, ["ok"]).collect()}
    assert got == {("task", "a"): 1.0, ("task", "b"): 0.0, ("overall", "all"): round(1 / 3, 6), ("macro", "all"): 0.5}
    assert scoring.summary(s.filter("false"), ["ok"]).count() == 0


def test_split_is_total_and_stable(spark):
    rows = spark.range(2000).select(F.concat_ws(":", (F.col("id") % 50).cast("string"), (F.col("id") % 31).cast("string")).alias("b"))
    got = rows.withColumn("s", splits.block_split(F.col("b")))
    again = rows.repartition(7).withColumn("s", splits.block_split(F.col("b")))
    assert got.filter("s is null").count() == 0 and got.exceptAll(again).count() == 0
    assert splits.leaks(got.withColumnRenamed("s", "split"), "b").count() == 0
    with pytest.raises(Exception, match="no city"):
        splits.unseen_city(spark.createDataFrame([("real_gis", None)], "source_type string, city string"), ["x"]).collect()


def test_actions():
    from quadrille.operators import rules

    spec = actions.Spec("s", {"move": ("entity_id", "target")}, (10, 12))
    state = {"entities": {"r": {"position": [0, 0]}}, "obstacles": [[2, 5]], "goal": {"r": [2, 4]}}
    act = lambda t, **k: {"operation": "move", "entity_id": "r", "target": t, **k}
    assert rules.violations(spec, state, act([2, 4])) == []
    assert rules.violations(spec, state, act([2, 5])) == ["target is blocked"]
    assert rules.violations(spec, state, act([True, 0])) == ["target must be [row, column] integer coordinates"]
    assert rules.violations(spec, state, {"operation": "fly"}) == ["unknown operation: fly"]
    moved = lambda s, a: {**s, "complete": True}
    assert len(actions.closed_loop(spec, state, lambda _: 'Act: {"operation":"move","entity_id":"r","target":[2,4]}', moved)) == 1
    with pytest.raises(ValueError):
        actions.closed_loop(spec, state, lambda _: 'Act: {"operation":"move","entity_id":"r","target":[2,5]}', moved)


def test_grid_search():
    assert best_moves(5, (0, 0), (4, 4), set()) == ["SE"] * 4 and best_moves(3, (0, 0), (0, 0), set()) == []
    assert best_moves(3, (0, 0), (2, 2), {(0, 1), (1, 0), (1, 1)}) is None
    assert len(best_moves(3, (0, 0), (0, 2), {(0, 1)})) == 2


def test_masks(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 7, 8])], "p array<int>, f array<int>")
    m = df.select(masks.loss_mask(F.col("p"), F.col("f"), 0, 9).alias("m")).first()["m"]
    assert (m["input_ids"], m["labels"]) == ([1, 2, 7, 8, 0], [-100, -100, 7, 8, 0])
    with pytest.raises(Exception, match="too long"):
        df.select(masks.loss_mask(F.col("p"), F.col("f"), 0, 4).alias("m")).collect()
    rows = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 3]), (1, [4], [4])], "b int, input_ids array<int>, labels array<int>")
    got = {len([x for x in r["attention_mask"] if x]): r for r in masks.padded(rows, "b", 9).collect()}
    assert got[1]["input_ids"] == [4, 9, 9] and got[1]["labels"] == [4, -100, -100]
