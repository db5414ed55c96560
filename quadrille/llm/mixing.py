"""Operator 9: mix sources to target weights by Sainte-Laguë apportionment.

Sources in code point order (null last) take weights 5, 2, 1, 5, ...; their
targets share all words, and no target exceeds ``cap`` times its source's size.
Blocks of ``block`` words are seats: sources receive seats by the highest
quotients target / (2 seats + 1), shards of a source by their sizes likewise.
Within a shard, documents stand on a ring in seeded order and the quota covers a
seeded arc of whole turns and a rest, so almost every document is taken whole.

A shard is a seeded hash slice of one source of about ``SHARD_WORDS`` words or
``SHARD_ROWS`` rows, so a hot source is many bounded groups.  Only per-source
totals (at most ``MAX_SOURCES``, checked) reach the driver.

Defined results: null texts have size 0 and take nothing; a null source is a
source of its own; repeated rows are separate documents; an empty table gives an
empty result; extra columns are ignored (or kept, by ``mixed``).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WEIGHTS = (5, 2, 1)
SHARD_WORDS, SHARD_ROWS = 1 << 20, 1 << 11
MAX_SOURCES = 1_000_000
CAP, BLOCK, SEED = 3.0, 16, 9
_WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of all words by weight, stopped at ``cap`` times the size, the excess reshared until none is above."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
        left = sum(sizes) - sum(out)
    return out


def seats(weights, total: int, most) -> np.ndarray:
    """Sainte-Laguë: ``total`` seats by the highest quotients w / (2a + 1), at most ``most`` each; ties to the smaller index."""
    w, most = np.asarray(weights, float), np.asarray(most, np.int64)
    if not len(w) or w.sum() <= 0 or total <= 0:
        return np.zeros(len(w), np.int64)
    a = np.minimum(np.floor(w / (w.sum() / total) + 0.5).astype(np.int64), most)
    gap = total - int(a.sum())
    if gap > 0:
        heap = [(-w[i] / (2 * a[i] + 1), i) for i in range(len(w)) if a[i] < most[i] and w[i] > 0]
        heapq.heapify(heap)
        while gap and heap:
            _, i = heapq.heappop(heap)
            a[i] += 1
            gap -= 1
            if a[i] < most[i]:
                heapq.heappush(heap, (-w[i] / (2 * a[i] + 1), i))
    elif gap < 0:
        heap = [(w[i] / (2 * a[i] - 1), -i) for i in range(len(w)) if a[i] > 0]
        heapq.heapify(heap)
        while gap:
            _, i = heapq.heappop(heap)
            a[-i] -= 1
            gap += 1
            if a[-i] > 0:
                heapq.heappush(heap, (w[-i] / (2 * a[-i] - 1), i))
    return a


def _quotas(t: pa.Table, block: int, cap: float) -> pa.Table:
    size = t["shard_size"].to_numpy()
    order = np.argsort(t["shard"].to_numpy(), kind="stable")
    q = np.zeros(len(size), np.int64)
    q[order] = seats(size[order], int(t["seats"][0].as_py()), np.floor(cap * size[order] / block).astype(np.int64))
    return pa.table({"sid": t["sid"], "shard": t["shard"], "shard_size": t["shard_size"], "quota": pa.array(q * block)})


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("sid", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("seats", T.LongType()), T.StructField("shards", T.IntegerType())])


def _planned(rows: DataFrame, weights, cap: float, block: int) -> DataFrame:
    """One row a source: size, target, seats, number of shards."""
    total = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(total) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    size = [int(r["size"]) for r in total]
    goal = targets(size, [weights[i % len(weights)] for i in range(len(size))], cap)
    seat = seats(goal, round(sum(goal) / block), [math.floor(cap * s / block) for s in size])
    plan = [(r["_source"], i, size[i], goal[i], int(seat[i]), max(1, math.ceil(size[i] / SHARD_WORDS), math.ceil(r["n"] / SHARD_ROWS))) for i, r in enumerate(total)]
    return rows.sparkSession.createDataFrame(plan, _PLAN)


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    key = F.md5(common.joined(seed, own, text))
    return df.withColumns({"_id": own, "_source": F.col(f"`{source_col}`").cast("string"), "_size": F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long"), "_h": common.digits(key, 1), "_o": common.digits(key, 16)})


def _taken(rows: DataFrame, weights, cap: float, block: int, seed: int) -> DataFrame:
    """Adds source_size, target, and the arc: turns (whole copies) and the rest's two possible word ranges."""
    plan = _planned(rows, weights, cap, block)
    dealt = rows.join(plan, rows["_source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("shard", F.pmod("_h", F.col("shards")).cast("int"))
    sums = dealt.groupBy("sid", "shard").agg(F.sum("_size").alias("shard_size"), F.first("seats").alias("seats"))

    def quotas(t: pa.Table) -> pa.Table:
        return _quotas(t, block, cap)

    quota = sums.groupBy("sid").applyInArrow(quotas, "sid int, shard int, shard_size long, quota long")
    w = Window.partitionBy("sid", "shard").orderBy("_o", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("_from", F.sum("_size").over(w) - F.col("_size")).join(quota, ["sid", "shard"])
    ring = F.greatest(F.col("shard_size"), F.lit(1))
    out = out.withColumns({"_turns": F.floor(F.col("quota") / ring), "_rest": F.pmod("quota", ring), "_arc": F.pmod(common.digits(F.md5(common.joined(seed, F.col("sid"), F.col("shard"))), 1), ring)})

    def overlap(a: Column, z: Column) -> tuple[Column, Column]:
        """The part of words [a, z) of the ring inside this document, in its own positions."""
        lo = F.greatest(a, F.col("_from")) - F.col("_from")
        hi = F.least(z, F.col("_from") + F.col("_size")) - F.col("_from")
        return lo, F.greatest(hi - lo, F.lit(0))

    end = F.col("_arc") + F.col("_rest")
    lo1, n1 = overlap(F.col("_arc"), F.least(end, ring))
    lo2, n2 = overlap(F.lit(0).cast("long"), F.greatest(end - ring, F.lit(0)))
    return out.withColumns({"_lo1": lo1, "_n1": n1, "_lo2": lo2, "_n2": n2}).withColumn("taken", (F.col("_turns") * F.col("_size") + F.col("_n1") + F.col("_n2")).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row."""
    rows = common.cut(_sized(df, id_col, text_col, source_col, seed).select("_id", "_source", "_size", "_h", "_o"))
    return _taken(rows, weights, cap, block, seed).select(F.col("_id").alias("id"), F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixture as rows of ``df``: the text is what the mix takes (copies on lines of their own); rows of which it takes nothing go."""
    got = _taken(_sized(df, id_col, text_col, source_col, seed), weights, cap, block, seed).filter("taken > 0")
    text = F.col(f"`{text_col}`").cast("string")
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def part(lo: str, n: str) -> Column:
        return F.when(F.col(n) == 0, None).when(F.col(n) == F.col("_size"), text).otherwise(F.array_join(F.slice(words, (F.col(lo) + 1).cast("int"), F.col(n).cast("int")), " "))

    new = F.concat_ws("\n", F.array_repeat(text, F.col("_turns").cast("int")), part("_lo1", "_n1"), part("_lo2", "_n2"))
    return got.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
