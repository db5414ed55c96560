"""Leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crc_unit


def block_split(block: Column, seed: int = 20260920, train: float = 0.8, validation: float = 0.1) -> Column:
    """Whole spatial blocks go to one split by a hash of seed and block."""
    u = crc_unit(F.concat(F.lit(f"{seed}:"), block))
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def unseen_city(df: DataFrame, held_out: list[str], city: str = "city", source: str = "source_type") -> DataFrame:
    """Adds ``split``; real rows must name their city (raises on read of such a row)."""
    named = F.when((F.col(source) == "real_gis") & (F.coalesce(F.trim(city), F.lit("")) == ""), F.raise_error(F.lit("a real-map row has no city"))).otherwise(F.col(city))
    return df.withColumn("split", F.when(F.coalesce(named.isin(*held_out), F.lit(False)), "test").otherwise("train"))


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)
