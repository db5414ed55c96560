"""Operator 5: length buckets with least padding, and token-budget batches inside them.

A length is the value of ``length_col`` (such as the token counts of operator 2) or
else the number of white-space words of the text.  The global histogram has one
row a length.  Dynamic programming over it (divide and conquer on the monotone
split point, narrow ranges one level at a time) chooses at most ``buckets`` boundaries
of least total padding, in whole numbers, for any number of lengths.  Only the histogram
reaches the driver; texts of W words in all have at most about sqrt(2 W) lengths.
Ranges of more than ``cells`` lengths are searched in pieces, and split points wait in
a file of the driver; neither changes the result.  Inside a bucket, seeded hash slices of
about ``SHARD`` rows are numbered independently and cut into batches whose padded
size stays within ``budget``.

Defined results: null and empty texts, and null or negative lengths, have length 0; a text longer than the
budget is a batch of its own; ties and repeated rows are ordered by a seeded
hash; an empty table gives an empty result; extra columns are kept by ``packed``.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .mixing import _WORD

SHARD = 20_000
BUCKETS, BUDGET, SEED = 16, 16_384, 5
#: Lengths that a step of the search holds at once.
CELLS = 1 << 16


def boundaries(longest, count, total, buckets: int, cells: int = CELLS) -> list[int]:
    """Upper bucket lengths of least padding for ascending cells (longest length, rows, sum of lengths; None: all of a cell are equal); of equal ones the first."""
    n = len(longest)
    if not n:
        return []
    # no sum exceeds twice the longest length times the rows
    kind = np.int64 if int(longest[-1]) * int(np.sum(count)) < 1 << 62 else object
    top = np.asarray(longest).astype(kind, copy=False)
    total = top * count if total is None else total
    c, s = (np.concatenate((np.zeros(1, kind), np.cumsum(np.asarray(v).astype(kind, copy=False)))) for v in (count, total))
    layers = min(buckets, n) - 1
    with tempfile.TemporaryFile() as splits:
        # least cost of the cells before each, with one bucket, then with one more a layer
        best = np.concatenate((np.zeros(1, kind), top * c[1:] - s[1:]))
        for _ in range(layers):
            best, at = _layer(best, top, c, s, cells)
            splits.write(at)
        out, end = [], n - 1
        for layer in reversed(range(layers)):
            out.append(int(top[end]))
            splits.seek((layer * n + end) * at.itemsize)
            end = int(np.frombuffer(splits.read(at.itemsize), at.dtype)[0]) - 1
            if end < 0:
                return out[::-1]
        return [int(top[end]), *out[::-1]]


def _layer(best, top, c, s, cells: int):
    """Costs with one bucket more, and the first cell of each last bucket."""
    n = len(top)
    new, at = np.zeros_like(best), np.empty(n, np.int32)
    cost_of = lambda i, m: best[i] + top[m] * (c[m + 1] - c[i]) - (s[m + 1] - s[i])
    # ranges of cells [lo, hi) have their last bucket start in first..last
    wide = [(0, n, 0, n - 1)]
    while wide:
        lo, hi, first, last = wide.pop()
        if hi - lo + last - first > cells:
            mid = (lo + hi) // 2
            least = pick = None
            for i in range(first, min(last, mid) + 1, cells):
                cost = cost_of(np.arange(i, min(i + cells, last + 1, mid + 1)), mid)
                k = int(np.argmin(cost))
                if pick is None or cost[k] < least:
                    least, pick = cost[k], i + k
            new[mid + 1], at[mid] = least, pick
            wide += [r for r in ((lo, mid, first, pick), (mid + 1, hi, pick, last)) if r[0] < r[1]]
            continue
        # all ranges of a level at once
        lo, hi, first, last = (np.array([v]) for v in (lo, hi, first, last))
        while len(lo):
            mid = (lo + hi) // 2
            many = np.minimum(last, mid) - first + 1
            edge = np.cumsum(many) - many
            i = np.repeat(first - edge, many) + np.arange(many.sum())
            cost = cost_of(i, np.repeat(mid, many))
            least = np.minimum.reduceat(cost, edge)
            hits = np.flatnonzero(cost == np.repeat(least, many))
            pick = i[hits[np.searchsorted(hits, edge)]]
            new[mid + 1], at[mid] = least, pick
            lo, hi, first, last = np.concatenate((lo, mid + 1)), np.concatenate((mid, hi)), np.concatenate((first, pick)), np.concatenate((pick, last))
            some = lo < hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return new, at


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED, length_col: str | None = None, cells: int = CELLS) -> DataFrame:
    """The rows of ``df`` with n_tokens, bucket, padded_to, padding, batch_id and slot."""
    text = F.col(f"`{text_col}`").cast("string")
    length = F.regexp_count(text, F.lit(_WORD)) if length_col is None else F.greatest(F.col(f"`{length_col}`"), F.lit(0))
    rows = df.withColumn("n_tokens", F.coalesce(length, F.lit(0)).cast("long"))
    lengths = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    longest, count = (lengths.column(k).to_numpy() for k in ("n_tokens", "n"))
    top = boundaries(longest, count, None, buckets, cells) or [0]
    held = np.diff(np.concatenate(([0], np.cumsum(count)))[np.searchsorted(longest, top, "right")], prepend=0).tolist()
    at = F.size(F.filter(F.array(*map(F.lit, top)), lambda b: b < F.col("n_tokens")))
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    h = common.digits(F.md5(common.joined(seed, F.col(f"`{id_col}`"), text)), 1)
    rows = rows.withColumn("bucket", at).withColumn("padded_to", pick(top).cast("long")).withColumn("_h", h)
    rows = rows.withColumn("_shard", F.pmod("_h", pick([max(1, -(-n // SHARD)) for n in held])).cast("int"))
    turn = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_h", "n_tokens")) - 1
    size = pick([max(1, budget // max(1, b)) for b in top])
    return rows.withColumn("_turn", turn).withColumns({
        "padding": F.col("padded_to") - F.col("n_tokens"),
        "batch_id": F.format_string("%d-%d-%d", F.col("bucket"), F.col("_shard"), F.floor(F.col("_turn") / size)),
        "slot": F.pmod(F.col("_turn"), size).cast("int"),
    }).drop("_turn", "_shard", "_h")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs).drop("text")
