"""Scores, rates, slices, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: str) -> Column:
    """Share of true, nulls counting as false, six decimals."""
    return F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")), 6)


def per_task(scores: DataFrame, flags: list[str], task: str = "task") -> DataFrame:
    return scores.groupBy(task).agg(F.count("*").alias("n"), *[rate(f).alias(f) for f in flags])


def summary(scores: DataFrame, flags: list[str], task: str = "task") -> DataFrame:
    """Rows ``(scope, name, n, flags)``: each task, all rows, and the mean of the tasks' rounded rates."""
    tasks = per_task(scores, flags, task)
    every = scores.agg(F.count("*").alias("n"), *[rate(f).alias(f) for f in flags])
    macro = tasks.agg(F.count("*").alias("n"), *[F.round(F.avg(f), 6).alias(f) for f in flags])
    return (tasks.select(F.lit("task").alias("scope"), F.col(task).alias("name"), "n", *flags)
            .unionByName(every.select(F.lit("overall").alias("scope"), F.lit("all").alias("name"), "n", *flags).filter("n > 0"))
            .unionByName(macro.select(F.lit("macro").alias("scope"), F.lit("all").alias("name"), "n", *flags).filter("n > 0")))


def accuracy_sets(scores: DataFrame, by: list[str], correct: str) -> DataFrame:
    """Accuracy by each column and overall in one pass: ``(level, name, n, correct, accuracy)``."""
    ok = F.col(correct).cast("int")
    levels = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in by], F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")))
    partial = scores.groupBy(*by).agg(F.count("*").alias("n"), F.sum(ok).alias("c"))
    got = partial.select(F.explode(levels).alias("l"), "n", "c").groupBy("l.level", "l.name").agg(F.sum("n").alias("n"), F.sum("c").alias("correct"))
    return got.withColumn("accuracy", F.col("correct") / F.col("n"))


def slices(scores: DataFrame, names: Column, correct: str, once: bool = False) -> DataFrame:
    """Accuracy of every slice name in an array column; a name twice in a row counts twice unless ``once``."""
    names = F.array_distinct(names) if once else names
    return scores.select(F.explode(names).alias("slice"), F.col(correct).cast("int").alias("ok")).groupBy("slice").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").withColumnRenamed("count", "n")


def gate(sample: DataFrame, failed: Column, least: float = 0.98) -> DataFrame:
    """One row: size, failures, pass rate, whether the rate reaches ``least``."""
    got = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum(failed.cast("int")), F.lit(0)).cast("long").alias("failures"))
    share = 1 - F.col("failures") / F.greatest("n", F.lit(1))
    return got.withColumn("passed", share >= least)


def review_metrics(labels: DataFrame, verdict: str = "verdict") -> DataFrame:
    n = F.count(verdict)
    return labels.agg(F.count("*").alias("records"), n.alias("labelled"), F.count_if(F.col(verdict) == "approved").alias("approved")).withColumn("percent", F.round(F.try_divide(F.col("approved") * 100.0, F.col("labelled")), 1))


def violations(checks: list[tuple[Column, str]]) -> Column:
    """Names of failed checks, in order; an unknown outcome fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks]))
