"""Joins with stated guarantees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_meet
from .sampling import head_per_group


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which a row without partner raises when it is read."""
    marked = right.withColumn("_there", F.lit(True))
    out = left.join(marked, key, "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return out.filter(ok).drop("_there")


def grid_join(left: DataFrame, right: DataFrame, box: tuple[str, ...] = ("x1", "y1", "x2", "y2"), key: str = "id", cell: float = 16.0) -> DataFrame:
    """Pairs of closed boxes that meet, as ``l_*`` and ``r_*`` columns, each once.

    Boxes are dealt out to the grid cells they touch; a pair counts in the cell of
    its intersection's lower corner only, so nothing has to be made distinct.
    """
    def cells(df: DataFrame, side: str) -> DataFrame:
        lo, hi = [F.floor(F.col(c) / cell) for c in box[:2]], [F.floor(F.col(c) / cell) for c in box[2:]]
        named = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], F.explode(F.sequence(lo[0], hi[0])).alias("cx"), F.sequence(lo[1], hi[1]).alias("_ys"))
        return named.withColumn("cy", F.explode("_ys")).drop("_ys")

    a, b = [tuple(F.col(f"{s}_{c}") for c in box) for s in ("l", "r")]
    corner = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("cy"))
    return cells(left, "l").join(cells(right, "r"), ["cx", "cy"]).filter(boxes_meet(a, b) & corner).drop("cx", "cy")


def neighbours(pairs: DataFrame, k: int, order: list) -> DataFrame:
    """At most ``k`` partners of each left box in seeded order, itself excluded."""
    return head_per_group(pairs.filter("l_id <> r_id"), ["l_id"], order, k)


def replace_rows(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` in which those whose key is in ``new`` are taken from there."""
    cols = [c for c in current.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    pick = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return current.join(n, key, "left").select(key, *pick)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys that only one side has; empty for equal sets."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def cell_size(area: float, rows: int, per_cell: int = 8) -> float:
    """A cell that holds about ``per_cell`` of ``rows`` evenly spread boxes."""
    return max(1e-9, math.sqrt(area * per_cell / max(1, rows)))


def skew_salted(left: DataFrame, right: DataFrame, key: str, salts: int, pick: Column) -> DataFrame:
    """Equi-join for a hot left key: its rows are spread over ``salts`` copies of the right side."""
    l = left.withColumn("_salt", F.pmod(F.xxhash64(pick), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"]).drop("_salt")
