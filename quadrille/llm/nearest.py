"""Operator 4: approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, rotated by a seeded random orthogonal matrix and kept as
one packed sign bit a component with correction scalars: its centred length, its
inner product with the centre, and how well the bits agree with it.  For a query
these give an unbiased estimate of the inner product and an error bound: a table of
256 sums a byte of code turns packed bits into the estimate, they are never
unpacked.  Vectors whose upper bound reaches the k-th best score so far, or the k-th
best lower bound of their block, are reranked with exact double-precision inner
products.

Codes and vectors are written once, a file each a block, to the shared folder; only
queries are shuffled.  A task holds a group of queries, streams the code files past
them and opens a block's vectors only if one of them is to be reranked.  Equal
vectors are stored once with their smallest k + 1 ids, so a hot vector costs one row.

All bounds are computed in double precision on vectors scaled by one power of two, so
any finite vector is safe; a bound that is no number counts as reached.

Defined results: vectors that are null, zero, of a length other than the most
frequent one, or hold null or non-finite components take no part; ties in score go
to the smaller id; of rows with one id the smallest vector counts; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a block, queries in a group, queries estimated at once.
BLOCK, QUERIES, TILE = 16_384, 512, 64


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _saved(fs, path: str, **arrays) -> None:
    """Written aside and moved, so a task that runs again leaves the same file."""
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(sink.getbuffer())
    fs.move(draft, path)


def _loaded(fs, path: str):
    with fs.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))


class Codes:
    """Packed bits and correction scalars of a block."""

    def __init__(self, bits, norm, fit, shift):
        self.bits, self.norm, self.fit, self.shift = bits, norm, fit, shift

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        rest = vectors - centre
        norm = np.linalg.norm(rest, axis=1)
        unit = rest / np.where(norm > 0, norm, 1.0)[:, None] @ turn
        # inner product of the unit vector with its own code, at most 1
        fit = np.where(norm > 0, np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1]), 1.0)
        return cls(np.packbits(unit > 0, axis=1), norm, fit, vectors @ centre)

    def bounds(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of the inner products, queries in rows."""
        dim = queries.shape[1]
        rest = queries - centre
        turned = np.zeros((len(queries), 8 * self.bits.shape[1]))
        turned[:, :dim] = rest @ turn
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
        along = np.zeros((len(queries), len(self.bits)))
        for p in range(self.bits.shape[1]):
            # sums of the eight components with the signs of each byte value
            along += (turned[:, 8 * p : 8 * p + 8] @ signs.T).take(self.bits[:, p], axis=1)
        # <o, q> = <o - c, q - c> + <o - c, c> + <c, q>
        along *= self.norm / self.fit / math.sqrt(dim)
        along += self.shift - centre @ centre
        along += (queries @ centre)[:, None]
        spread = np.sqrt(np.maximum(0.0, 1 - self.fit**2)) / self.fit * self.norm * width / math.sqrt(max(1, dim - 1))
        return along, np.linalg.norm(rest, axis=1)[:, None] * spread


def _exact(columns: np.ndarray, pick: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Component by component in one order, so equal vectors get equal scores."""
    score = np.zeros(len(pick))
    for column, q in zip(columns, query):
        score += column[pick] * q
    return score


def _stored(t: pa.Table, folder: str, centre: np.ndarray, seed: int, scale: float) -> pa.Table:
    vectors = np.asarray(pa.concat_arrays([c.flatten() for c in t["v"].chunks]), np.float64).reshape(t.num_rows, -1) / scale
    codes = Codes.of(vectors, centre, rotation(len(centre), seed))
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{t['block'][0].as_py()}")
    _saved(fs, f"{path}.codes", **vars(codes))
    ids = t["ids"].combine_chunks()
    _saved(fs, f"{path}.vectors", columns=np.ascontiguousarray(vectors.T), ids=np.asarray(ids.flatten()), edge=np.asarray(ids.offsets) - ids.offsets[0].as_py())
    return pa.table({"block": t["block"].slice(0, 1), "n": pa.array([t.num_rows], pa.int64())})


def _grouped(t: pa.Table, scale: float) -> pa.Table:
    values = np.asarray(pa.concat_arrays([c.flatten() for c in t["v"].chunks]), np.float64) / scale
    return pa.table({"values": pa.array([values.tobytes()], pa.binary()), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64()))})


class _Best:
    """The ``k`` best of one query so far."""

    def __init__(self, own: int, k: int):
        self.own, self.k, self.held, self.least = own, k, [], -math.inf

    def add(self, score: np.ndarray, pick: np.ndarray, ids: np.ndarray, edge: np.ndarray) -> None:
        new = [(-s, other) for s, p in zip(score.tolist(), pick.tolist()) for other in ids[edge[p] : edge[p + 1]].tolist() if other != self.own]
        self.held = sorted(self.held + new)[: self.k]
        if len(self.held) == self.k:
            self.least = -self.held[-1][0]


def _searched(batches, folder: str, k: int, centre: np.ndarray, seed: int, width: float, scale: float):
    dim = len(centre)
    turn = rotation(dim, seed)
    fs, path = pafs.FileSystem.from_uri(folder)
    for b in batches:
        for row in b.to_pylist():
            queries = np.frombuffer(row["values"], np.float64).reshape(-1, dim)
            best = [_Best(own, k) for own in row["ids"]]
            for block in range(row["first"], row["last"]):
                codes, vectors = Codes(**_loaded(fs, f"{path}/{block}.codes")), None
                # an own vector may be no candidate, hence one more
                most = min(k + 1, len(codes.bits))
                for lo in range(0, len(queries), TILE):
                    part = queries[lo : lo + TILE]
                    estimate, error = codes.bounds(part, centre, turn, width)
                    lower = np.partition(estimate - error, -most, axis=1)[:, -most]
                    least = np.fmax(lower, [x.least for x in best[lo : lo + TILE]])
                    reach = ~(estimate + error < least[:, None])
                    if not reach.any():
                        continue
                    if vectors is None:
                        vectors = _loaded(fs, f"{path}/{block}.vectors")
                        columns, ids, edge = vectors["columns"], vectors["ids"], vectors["edge"]
                        longest = np.sqrt((columns**2).sum(axis=0)).max()
                    dense = part @ columns if reach.mean() > 0.02 else None
                    for i, query in enumerate(part):
                        pick, mine = np.flatnonzero(reach[i]), best[lo + i]
                        rough = dense[i, pick] if dense is not None else query @ columns[:, pick]
                        # the order of sums may move a rough score by far less than this
                        slack = 1e-11 * longest * np.linalg.norm(query)
                        floor = max(mine.least, np.partition(rough, -min(most, len(rough)))[-min(most, len(rough))]) - slack if len(rough) else 0.0
                        pick = pick[~(rough < floor)]
                        mine.add(_exact(columns, pick, query), pick, ids, edge)
            found = [(x.own, other, -s * scale * scale) for x in best for s, other in x.held]
            if found:
                own, other, score = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(other, pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries=None, k: int = 20, width: float = 4.0, seed: int = 4, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of each query row found; ``queries`` is a predicate on the id column ``id``.

    ``width`` is the error bound in standard deviations of the estimate.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    dim = sizes["d"]
    rows = rows.filter(F.size("v") == dim)
    # equal vectors: the smallest k + 1 ids of each; partial limits run before the shuffle
    key = [F.xxhash64("v"), F.col("v")]
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = common.cut(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    count, largest = distinct.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    scale = 2.0 ** math.frexp(largest)[1]
    centre = np.array(distinct.select(*[F.avg(F.col("v")[i] / scale) for i in range(dim)]).first(), float)
    asked = rows if queries is None else rows.filter(queries)
    n_queries = asked.count()
    if not n_queries:
        return empty
    folder = common.scratch(spark, "nearest")
    n_blocks, groups = math.ceil(count / block), math.ceil(n_queries / QUERIES)

    def store(t: pa.Table) -> pa.Table:
        return _stored(t, folder, centre, seed, scale)

    def group(t: pa.Table) -> pa.Table:
        return _grouped(t, scale)

    # a block that no vector falls into has no file, so blocks are numbered by those that exist
    dealt = distinct.withColumn("h", F.pmod(F.xxhash64("v"), F.lit(n_blocks)))
    used = dealt.select("h").distinct().withColumn("block", F.row_number().over(Window.orderBy("h")) - 1)
    written = common.cut(dealt.join(used, "h").select(F.col("block").cast("long"), "v", "ids").groupBy("block").applyInArrow(store, "block long, n long")).count()
    # few groups of queries each search ranges of the blocks in several tasks
    ranges = min(written, max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / groups)))
    edges = [round(i * written / ranges) for i in range(ranges + 1)]
    parts = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(z).alias("last")) for a, z in zip(edges, edges[1:])])).alias("part")
    wanted = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")).applyInArrow(group, "values binary, ids array<long>")
    tasks = wanted.select("values", "ids", parts).select("values", "ids", "part.first", "part.last").repartition(groups * ranges)
    found = tasks.mapInArrow(partial(_searched, folder=folder, k=k, centre=centre, seed=seed, width=width, scale=scale), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0)
