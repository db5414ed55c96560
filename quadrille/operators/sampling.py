"""Seeded, exactly reproducible sampling: order by md5 of seed and key, never by a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, *keys: Column) -> Column:
    """Text order key; the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def head_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows of each group (partial limits run before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def round_robin(df: DataFrame, group: str, order: list, name: str = "turn") -> DataFrame:
    """Position of a row inside its group; ordering by (turn, group) deals the groups out in turn."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def take_round_robin(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """``n`` rows, one of each group at a time.  No group needs more than ``n`` of its rows."""
    w = Window.partitionBy(group).orderBy(*order)
    few = df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    return few.orderBy("turn", group).limit(n)


def sample_size(n: Column, rate: float) -> Column:
    """Half-to-even size of a sample, one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(rate)).cast("long"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return head_per_group(df, keys, order, 1)


def require_count(df: DataFrame, n: int, what: str) -> DataFrame:
    got = df.count()
    if got != n:
        raise ValueError(f"{what}: {got} rows, expected {n}")
    return df


def alternate(df: DataFrame, flag: str, order: list, n: int) -> DataFrame:
    """``n`` rows that alternate between true and false, true first; the order inside each class is given."""
    w = Window.partitionBy(flag).orderBy(*order)
    few = df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= (n + 1) // 2)
    return few.orderBy("turn", F.desc(flag)).limit(n)
