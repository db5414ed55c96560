"""Rewards of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import STAGES, extract_answer, normalize_answer


# The rewards' sizes.


def conclusion_reward(completion: Column, expected: Column) -> Column:
    """1 right, -1 wrong, -1.4 without any stage heading."""
    any_stage = F.lit(False)
    for s in STAGES:
        any_stage = any_stage | completion.rlike(rf"(?im)^\s*{s}\s*:")
    right = normalize_answer(extract_answer(completion)) == normalize_answer(expected)
    return F.when(~any_stage, -1.4).when(right, 1.0).otherwise(-1.0)


def format_reward(completion: Column) -> Column:
    """A tenth for each stage with content, minus one for each without and for disorder; within 0.4 of zero.

    A stage counts as present if any text follows its heading, on whatever line.
    """
    at = [F.regexp_instr(completion, F.lit(rf"(?im)^\s*{s}\s*:\s*\S")) for s in STAGES]
    score = F.lit(0)
    for a in at:
        score = score + F.when(a > 0, 1).otherwise(-1)
    present = F.filter(F.array(*at), lambda p: p > 0)
    tenths = score - F.when(present == F.array_sort(present), 0).otherwise(1)
    return F.greatest(F.lit(-4), F.least(F.lit(4), tenths)) / 10.0


def flat_reward(completion: Column, expected: Column) -> Column:
    return F.round(conclusion_reward(completion, expected) + format_reward(completion), 4)


def map_reward(answer_right: Column, verified: Column, completion: Column, minimal: Column, weights=(1.0, 0.1, 0.05)) -> Column:
    """STRUCT<answer, gis, reasoning, format, total>: the verifier weighs most."""
    tokens = F.filter(F.split(F.lower(F.replace(minimal, F.lit("->"), F.lit(" "))), r"\s+"), lambda t: F.length(t) > 1)
    hit = F.exists(tokens, lambda t: F.contains(F.lower(completion), t))
    parts = [F.when(answer_right, 1.0).otherwise(-1.0), weights[0] * F.when(verified, 1.0).otherwise(-1.0), F.when(hit, weights[1]).otherwise(0.0), weights[2] * (format_reward(completion) / 0.4)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("answer", "gis", "reasoning", "format"))], F.round(parts[0] + parts[1] + parts[2] + parts[3], 4).alias("total"))


def group_advantage(df: DataFrame, group: list[str], reward: str, name: str = "advantage", epsilon: float = 1e-6) -> DataFrame:
    """(reward - mean) / (population deviation + epsilon) inside each group, from two aggregates and a join back.

    A window would gather a whole group in one task; the aggregates combine before the shuffle.
    """
    stats = df.groupBy(*group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return df.join(stats, group).withColumn(name, (F.col(reward) - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def group_advantage_windowed(df: DataFrame, group: list[str], reward: str, name: str = "advantage", epsilon: float = 1e-6) -> DataFrame:
    """The same for groups of a few candidates each, without a join."""
    w = Window.partitionBy(*group)
    return df.withColumn(name, (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon))
