"""Records of a dataset: recovery, replacement, review, contracts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins
from .sampling import take_round_robin


def recover(rejected: DataFrame, known: DataFrame, emitted: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(recovered, still rejected): rejected rows that are known, valid now, and not emitted yet; the rest stays with a reason."""
    found = rejected.join(known.withColumn("_known", F.lit(True)), key, "left").join(emitted.select(key).distinct().withColumn("_out", F.lit(True)), key, "left")
    why = F.when(F.col("_known").isNull(), "unknown").when(F.col("_out"), "already emitted").when(~F.coalesce(valid, F.lit(False)), "still invalid")
    marked = found.withColumn("reason", why).drop("_known", "_out")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def replace_checked(current: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Replace rows by key; the keys of ``new`` must be exactly those of ``current`` that are in ``keys``."""
    due = current.join(keys.select(key).distinct(), key, "left_semi")
    if not joins.difference(due, new, key).isEmpty():
        raise ValueError("the replacement's keys are not the current ones")
    return joins.replace_rows(current, new, key)


def styles_by_scenario(rows: DataFrame, styles: list[str], required: str, key: str = "scenario_id", style: str = "style", value: str = "content") -> DataFrame:
    """One row a scenario, one column a style; a scenario without ``required`` raises when it is read."""
    wide = rows.groupBy(key).pivot(style, styles).agg(F.first(value))
    ok = F.when(F.col(required).isNull(), F.raise_error(F.concat(F.lit(f"no {required} view of "), F.col(key)))).otherwise(F.lit(True))
    return wide.filter(ok)


def review_sample(wide: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """Scenarios for review, dealt out over the groups."""
    return take_round_robin(wide, group, order, n)


def review_markdown(sample: DataFrame, key: str, order: str, sections: list[str]) -> DataFrame:
    """One text row: a heading a scenario and a part a column.  ``sample`` is a bounded review sample."""
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col(key)), *[F.concat(F.lit(f"**{s}**\n\n"), F.coalesce(F.col(s), F.lit("-"))) for s in sections])
    return sample.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("md")))), lambda x: x["md"]), "\n\n").alias("markdown"))


def taxonomy_violations(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows with ``problems``: unknown concept, or skill or task type outside it; ``taxonomy``: (concept, skills, task_types)."""
    t = taxonomy.select(F.col("concept").alias("_c"), "skills", "task_types")
    j = rows.join(t, rows["concept"] == F.col("_c"), "left")
    known = F.col("_c").isNotNull()
    problems = F.array_compact(F.array(F.when(~known, "unknown concept"), F.when(known & ~F.array_contains("skills", F.col("skill")), "skill outside concept"), F.when(known & ~F.array_contains("task_types", F.col("task_type")), "task type outside concept")))
    return j.withColumn("problems", problems).drop("_c", "skills", "task_types")


def manifest_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def entity_refs(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """Sorted distinct references of each record (bounded by its scene)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(refs)).alias("entity_refs"))


def missing_keys(required: list[str], tags: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.map_keys(tags)))
