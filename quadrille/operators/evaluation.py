"""Reports of scored predictions, groups of candidates, local scenes, location pools, atomic examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import rewards as R
from . import generators, graph, scoring

#: Bounds of a local scene: nodes in the ball at least, nodes kept (its source included), edges at least and at most.
NEAR, KEPT, FEWEST, MOST = 4, 14, 3, 28


def report(scores: DataFrame, flags: list[str], exact: str = "act_exact", key: str = "scenario_id") -> DataFrame:
    """One row: records, errors, the overall rates as JSON, and the first thousand ids in error, in order.

    The list is for reading; ``errors`` has all rows.
    """
    every = scores.agg(F.count("*").alias("records"), F.count_if(~F.coalesce(F.col(exact), F.lit(False))).alias("errors"), *[scoring.rate(f).alias(f) for f in flags])
    first = errors(scores, exact).select(F.col(key).alias("k")).orderBy("k").limit(1000).agg(F.array_sort(F.collect_list("k")).alias("error_ids"))
    return every.select("records", "errors", F.to_json(F.struct(*flags)).alias("rates")).crossJoin(first)  # one row each


def errors(scores: DataFrame, exact: str = "act_exact") -> DataFrame:
    return scores.filter(~F.coalesce(F.col(exact), F.lit(False)))


def oracle_predictor(questions: DataFrame, gold: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """``questions`` with the gold answer as ``prediction``: null where a question is unknown or has several answers."""
    known = gold.groupBy(question).agg(F.min(answer).alias("prediction"), F.count_distinct(answer).alias("n")).filter("n = 1").drop("n")
    return questions.join(known, question, "left")


def score_candidates(groups: DataFrame, key: str, candidates: str = "candidates", expected: str = "expected") -> DataFrame:
    """``(key, position, reward, advantage)`` for every candidate completion of each group's array."""
    each = groups.select(key, expected, F.posexplode(candidates).alias("position", "completion"))
    scored = each.select(key, "position", R.flat_reward(F.col("completion"), F.col(expected)).alias("reward"))
    return R.group_advantage(scored, [key], "reward")


def local_scenes(edges: DataFrame, seeds: DataFrame, hops: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and induced edges of the local scenes that are large enough and not too large.

    A scene is the ball around its source, the source first, then the others by a
    seeded hash, ``KEPT`` in all; balls under ``NEAR`` nodes and scenes with fewer
    than ``FEWEST`` or more than ``MOST`` edges go.
    """
    w = Window.partitionBy("seed")
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("seed").cast("string"), F.col("node").cast("string")))
    near = graph.ball(edges, seeds, hops).withColumns({"near": F.count("*").over(w), "turn": F.row_number().over(w.orderBy(F.desc(F.col("node") == F.col("seed")), order))})
    members = near.filter((F.col("near") >= NEAR) & (F.col("turn") <= KEPT)).select(F.col("seed").alias("scene"), "node")
    inside = graph.induced(edges, members)
    sound = inside.groupBy("scene").agg(F.count("*").alias("edges")).filter(F.col("edges").between(FEWEST, MOST)).select("scene")
    return members.join(sound, "scene", "left_semi"), inside.join(sound, "scene", "left_semi")


def location_pool(points: DataFrame, areas: DataFrame) -> DataFrame:
    """``(kind, id, x, y)``: points and the anchors of areas together; rows without an id or a finite place go."""
    both = points.select(F.lit("poi").alias("kind"), F.col("id").cast("long").alias("id"), "x", "y").unionByName(areas.select(F.lit("aoi").alias("kind"), F.col("id").cast("long").alias("id"), "x", "y"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return both.filter(F.col("id").isNotNull() & fine(F.col("x")) & fine(F.col("y")))


# Question forms of the direction skill; the last is kept for the linguistic split.
DIRECTION_QUESTIONS = (
    "What is the direction of {b} relative to {a}?",
    "Which direction from {a} leads to {b}?",
    "{b} lies on which side of {a}?",
)


def direction_question(form: int | Column, a: Column, b: Column) -> Column:
    said = [F.replace(F.replace(F.lit(q), F.lit("{a}"), a), F.lit("{b}"), b) for q in DIRECTION_QUESTIONS]
    return said[form] if isinstance(form, int) else F.element_at(F.array(*said), form + 1)


def direction_examples(spark: SparkSession, n: int, seed: int = 2026, unusual: bool = False) -> DataFrame:
    """``(id, question, answer, tags)`` of two seeded points; a second point equal to the first moves one step east."""
    d = generators.Draws(seed, "direction", F.col("id"))
    rows = spark.range(n).withColumns({"ax": d.at(0, -20, 20), "ay": d.at(1, -20, 20), "bx": d.at(2, -20, 20), "by": d.at(3, -20, 20)})
    rows = rows.withColumn("bx", F.col("bx") + F.when((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")), 1).otherwise(0))
    place = lambda who, x, y: F.format_string(f"Object {who} at (%d, %d)", x, y)
    a, b = place("A", F.col("ax"), F.col("ay")), place("B", F.col("bx"), F.col("by"))
    question = direction_question(2 if unusual else d.at(4, 0, 1), a, b)
    tags = F.array(F.lit("synthetic"), F.lit("linguistic_ood" if unusual else "in_domain"))
    return rows.select(F.concat(F.lit("direction-"), F.lpad((F.col("id") + 1).cast("string"), 7, "0")).alias("id"), question.alias("question"), G.sign_direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("answer"), tags.alias("tags"))


def map_directions(pairs: DataFrame, anonymous: bool) -> DataFrame:
    """``(a_id, question, answer)`` of projected points (a_id, ax, ay, bx, by, a_name, b_name); equal points have no direction and go."""
    name = lambda c, stand: F.lit(stand) if anonymous else F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(stand))
    place = lambda who, x, y: F.concat(who, F.format_string(" at (%.3f, %.3f)", x, y))
    a, b = place(name("a_name", "Object A"), F.col("ax"), F.col("ay")), place(name("b_name", "Object B"), F.col("bx"), F.col("by"))
    answer = G.sign_direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return pairs.select("a_id", direction_question(0, a, b).alias("question"), answer.alias("answer")).filter("answer is not null")


def atomic_examples(spark: SparkSession, per_skill: int, seed: int = 2026, structural: bool = False, unusual: bool = False) -> DataFrame:
    """``(id, concept, answer)``: directions (drawn with ``seed``), box relations and link connectivity in turn, ``per_skill`` each."""
    def turns(cases: DataFrame, name: str, answer: str, order: list[str]) -> DataFrame:
        numbered = cases.select(F.col(answer).alias("answer"), (F.array_position(F.array(*map(F.lit, order)), F.col(answer)) - 1).alias("k"))
        ids = spark.range(per_skill).withColumn("k", F.col("id") % len(order))
        return ids.join(F.broadcast(numbered), "k").select(F.concat(F.lit(f"{name}-"), F.lpad((F.col("id") + 1).cast("string"), 7, "0")).alias("id"), F.lit(name).alias("concept"), "answer")

    boxes = turns(generators.box_cases(spark, 3 if structural else 1), "topology", "answer", ["Contains", "Within", "Touches", "Intersects", "Disjoint"])
    links = turns(generators.link_cases(spark, structural), "connectivity", "scene", ["Connected", "Disconnected"])
    return direction_examples(spark, per_skill, seed, unusual).select("id", F.lit("direction").alias("concept"), "answer").unionByName(boxes).unionByName(links)


def with_aliases(examples: DataFrame, **aliases: str) -> DataFrame:
    """Columns again under other names, such as ``input="question"``; a name that is taken is an error."""
    taken = set(aliases) & set(examples.columns)
    if taken:
        raise ValueError(f"columns exist: {sorted(taken)}")
    return examples.withColumns({new: F.col(f"`{old}`") for new, old in aliases.items()})


def flat_ids(df: DataFrame, column: str, field: str = "input_ids") -> Column:
    """Token ids of a column as one flat array: a struct or map gives its ``field``; one level of nesting goes, deeper is an error."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.StructType):
        c, kind = c.getField(field), kind[field].dataType
    elif isinstance(kind, T.MapType):
        c, kind = F.element_at(c, field), kind.valueType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{column} holds no token ids")
    if isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    if not isinstance(kind.elementType, T.IntegralType):
        raise TypeError(f"{column} holds no token ids")
    return F.transform(c, lambda x: x.cast("long"))
