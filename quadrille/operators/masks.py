"""Token rows for supervised training: loss masks and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def loss_mask(prompt: Column, full: Column, eos: int, longest: int) -> Column:
    """STRUCT<input_ids, labels>: the prompt's labels are ignored, the end token is kept.

    A prompt that is no prefix, an empty answer or too long a row raises: nothing is truncated.
    """
    ids = F.when(F.element_at(full, -1) == eos, full).otherwise(F.array_append(full, F.lit(eos)))
    n = F.size(prompt)
    problem = (F.when(F.slice(full, 1, n) != prompt, F.lit("the prompt is no prefix")).when(F.size(full) <= n, F.lit("no answer tokens"))
               .when(F.size(ids) > longest, F.lit("too long")))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))
    return F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.struct(ids.alias("input_ids"), labels.alias("labels")))


def padded(df: DataFrame, batch: str, pad: int) -> DataFrame:
    """Rows of a batch padded to its longest, with an attention mask."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_n"))
    gap = F.col("_n") - F.size("input_ids")
    fill = lambda v: F.array_repeat(F.lit(v), gap)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), fill(0))
    return df.join(longest, batch).withColumns({"attention_mask": mask, "labels": F.concat("labels", fill(IGNORED)), "input_ids": F.concat("input_ids", fill(pad))}).drop("_n")
