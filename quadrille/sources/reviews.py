"""Review packages, their labels, manifests and dataset cards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "scenario_id string, skill string, question string, views map<string,string>"
LABEL = "scenario_id string, verdict string, note string"


def write_package(sample: DataFrame, path: str, batch: str) -> None:
    """One JSON document of a bounded review sample: ``{"batch_id", "records": [...]}``."""
    doc = sample.agg(F.to_json(F.struct(F.lit(batch).alias("batch_id"), F.array_sort(F.collect_list(F.struct("scenario_id", "skill", "question", "views")), lambda a, b: F.when(a["scenario_id"] < b["scenario_id"], -1).when(a["scenario_id"] > b["scenario_id"], 1).otherwise(0)).alias("records"))).alias("value"))
    doc.coalesce(1).write.mode("errorifexists").text(path)


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """Records that have an ``ooda`` view; a document without records gives none."""
    docs = spark.read.schema(f"batch_id string, records array<struct<{RECORD.replace(' string', ':string').replace(' map', ':map')}>>").option("multiLine", True).json(path)
    return docs.select(F.explode("records").alias("r")).select("r.*").filter(F.element_at("views", "ooda").isNotNull())


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path)


def manifest_json(counts: DataFrame, by: list[str], **facts) -> str:
    """Counts per group (a bounded table) and invariants as one JSON object."""
    rows = counts.orderBy(*by).collect()
    return json.dumps({**facts, "counts": {"/".join(str(r[c]) for c in by): r["n"] for r in rows}, "total": sum(r["n"] for r in rows)}, ensure_ascii=False, sort_keys=True)


def dataset_card(name: str, counts: dict[str, int], licence: str) -> str:
    lines = [f"# {name}", "", f"Licence: {licence}", "", "| Split | Records |", "|-|-|", *[f"| {k} | {v} |" for k, v in counts.items()], "", f"Total: {sum(counts.values())}"]
    return "\n".join(lines)


def held_out(records: DataFrame, style: str = "ooda") -> DataFrame:
    """Test rows of one style with two messages and a known task; ``problems`` names what is wrong, duplicates included."""
    from ..functions.text import task_of
    from ..functions.verify import two_messages

    twice = records.groupBy("scenario_id").agg((F.count("*") > 1).alias("twice"))
    j = records.filter((F.col("split") == "test") & (F.col("style") == style)).join(twice, "scenario_id")
    checks = [(two_messages(F.col("messages")), "messages"), (task_of(F.col("scenario_id")).isNotNull(), "task"), (~F.col("twice"), "duplicate")]
    return j.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks]))).drop("twice")


def write_evaluation(scores: DataFrame, path: str, flags: list[str], exact: str = "act_exact", key: str = "scenario_id", overwrite: bool = False, **facts) -> None:
    """``predictions`` and ``errors`` as JSON lines, ``report`` as one JSON object with the given facts; an existing report is an error unless ``overwrite``."""
    from ..operators import evaluation

    mode = "overwrite" if overwrite else "errorifexists"
    about = [F.lit(v).alias(k) for k, v in facts.items()]
    report = evaluation.report(scores, flags, exact, key).withColumn("rates", F.from_json("rates", ", ".join(f"{f} double" for f in flags)))
    report.select(F.to_json(F.struct(*about, "records", "errors", "rates", "error_ids")).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/report")
    scores.write.mode(mode).json(f"{path}/predictions")
    evaluation.errors(scores, exact).write.mode(mode).json(f"{path}/errors")
