"""Operator 1: SimHash near-duplicate groups with pigeonring filtering.

A fingerprint is a ring of bits cut into equal segments.  By the pigeonring
principle two rings that differ in few bits have a start segment from which all
chains of consecutive segments stay within budgets proportional to their length.
Rows meet in *tables*, one a start: a table's key is what such a chain forces to
be equal, and beside the key a row carries the following bits of the ring, so a
chain is checked segment by segment without fetching anything.  Only pairs whose
chains hold go on.  A key row has a constant size (key, chain, id).

``near_duplicates``: ``shingle``-word shingles with repeats, 64 bits (set where
more than half of the shingle hashes have it); the tables are complete for ``tau``
differing bits and the chain covers the whole ring, so it is the full Hamming check.

``similar_texts``: 4,020 bits of the set of five-word shingles; 201 tables of
20-bit keys, chains of 96 further bits.  Keys, chains and budgets are the same at
every table size.  The components of these candidates are then decided exactly,
all pairs, by the Jaccard similarity of whole texts.

Defined results: null or wordless texts have fingerprint zero and link like any
other; repeated rows and ties share a class; rows whose id is null get the
smallest id reachable through their fingerprint class, or null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import shingle_sets, sketches

_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(common.WORD)
#: Largest bucket held in one piece; the rows of larger ones are dealt out as pairs of blocks.
BLOCK = 4096
#: Texts, and shingles of texts, compared in one piece.
TEXTS, SHINGLES = 1024, 4 << 20
_PIECE = 1 << 16


def _hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """Shingle hashes (XXH64, seed 42) in pieces of bounded size."""
    words = _WORD.findall(text.translate(_LOWER))
    n = len(words) - width + 1
    digest, join = xxhash.xxh64_intdigest, " ".join
    if words and n < 1:
        yield np.array([digest(join(words).encode("utf-8", "surrogatepass"), 42)], dtype=np.uint64)
    for a in range(0, max(n, 0), _PIECE):
        yield np.array([digest(join(words[i : i + width]).encode("utf-8", "surrogatepass"), 42) for i in range(a, min(n, a + _PIECE))], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> bytes:
    """8 bytes, most significant bit first."""
    ones, total = np.zeros(64, np.int64), 0
    for h in _hashes(text or "", width):
        total += len(h)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # column sums as bytes cannot overflow within 255 rows
        for a in range(0, len(bits), 255 * 64):
            part = bits[a : a + 255 * 64]
            ones += part.sum(axis=0, dtype=np.uint32) if len(part) > 255 else part.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > total).tobytes() if total else bytes(8)


def _fingerprints(batches, width: int):
    for b in common.slices(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: one binary fingerprint a row."""
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return src.mapInArrow(partial(_fingerprints, width=width), "id long, fp binary")


# ---- candidate tables -------------------------------------------------------------------------


def exact_tables(tau: int, segments: int = 8) -> list[tuple[int, int, tuple[int, int]]]:
    """For 64-bit rings: (start segment, segments forced equal, bit range of the following chain that must also be equal).

    ``free`` leading segments have budget 0; the next run of segments whose
    cumulative budget is ``b`` is cut into b+1 parts, one of which is equal.
    """
    size = 64 // segments
    budget = [length * tau // segments for length in range(segments + 1)]
    free = max(length for length in range(segments + 1) if budget[length] == 0)
    if free == 0:
        raise ValueError("tau needs more segments")
    if free == segments:
        return [(0, segments, (0, 0))]
    end = max(length for length in range(segments + 1) if budget[length] == budget[free + 1])
    parts = budget[free + 1] + 1
    cuts = [free * size + round(i * (end - free) * size / parts) for i in range(parts + 1)]
    return [(s, free, (cuts[p], cuts[p + 1])) for s in range(segments) for p in range(parts)]


_KEYS = "key long, chain long, id long"


def _exact_keys(batches, tables, size: int):
    for b in batches:
        if not b.num_rows:
            continue
        fp = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64)
        for n, (start, free, (lo, hi)) in enumerate(tables):
            ring = _rotate(fp, start * size)
            key = ring >> np.uint64(64 - free * size)
            if hi > lo:
                key = (key << np.uint64(hi - lo)) | ((ring >> np.uint64(64 - hi)) & np.uint64((1 << (hi - lo)) - 1))
            with np.errstate(over="ignore"):
                key = key * np.uint64(len(tables)) + np.uint64(n)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ring.view(np.int64)), b.column(0)], names=["key", "chain", "id"])


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k)) if k else x


class _Chains:
    """Pairs of key rows whose chains of consecutive bytes stay within ``budget`` (one entry a length).

    The chain is the ``low`` lowest bits of the key, then the 64 bits of ``chain``;
    rows of one bucket agree in the rest of the key.
    """

    def __init__(self, low: int, budget: tuple[int, ...]):
        self.low, self.budget = low, budget

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return key >> self.low if self.low else key

    def holds(self, key, chain, i, j) -> np.ndarray:
        """Positions among the pairs (i, j) whose chains stay within the budgets; the longest is tested first."""
        mask = np.uint64((1 << self.low) - 1)
        x, y = (key[i] ^ key[j]).view(np.uint64) & mask, (chain[i] ^ chain[j]).view(np.uint64)
        at = np.flatnonzero(np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= self.budget[-1])
        x, y = x[at], y[at]
        for n, most in enumerate(self.budget[:-1], 1):
            if not len(at):
                break
            d = np.bitwise_count(x >> np.uint64(max(0, self.low - 8 * n))).astype(np.int16)
            if 8 * n > self.low:
                d = d + np.bitwise_count(y >> np.uint64(64 - (8 * n - self.low)))
            ok = d <= most
            if not ok.all():
                at, x, y = at[ok], x[ok], y[ok]
        return at


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair in place; every label stays the smallest position of its set."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            root = label[label]
            if (root == label).all():
                break
            label[:] = root


def _inside(link: _Chains, key, chain) -> np.ndarray:
    """Component labels of rows sorted by key; memory is linear in the rows."""
    bucket = link.bucket(key)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    size = np.diff(edge)
    end, label = np.repeat(edge[1:], size), np.arange(len(key))
    rows = np.flatnonzero(np.repeat(size, size) > 1)
    step = 1
    while True:
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            return label
        i = rows[label[rows] != label[rows + step]]
        i = i[link.holds(key, chain, i, i + step)]
        _unite(label, i, i + step)
        step += 1


def _across(link: _Chains, key, chain, first: int) -> np.ndarray:
    """Component labels of the links between rows before and from ``first`` on, all of one bucket."""
    label = np.arange(len(key))
    right = np.arange(first, len(key))
    for i in range(first):
        j = right[label[right] != label[i]]
        j = j[link.holds(key, chain, np.full(len(j), i), j)]
        _unite(label, np.full(len(j), i), j)
    return label


def _star(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest id of each component to its other ids."""
    least = ids.copy()
    np.minimum.at(least, label, ids)
    src = least[label]
    at = src != ids
    return src[at], ids[at]


def _met(batches, link: _Chains, block: int):
    """Links of each bucket, a star a component (kind 0); rows of buckets over ``block`` pass through one by one (kind 1)."""

    def links_of(key, chain, ids):
        src, dst = _star(_inside(link, key, chain), ids)
        return out(0, np.zeros(len(src), np.int64), src, dst)

    def out(kind, key, src, dst):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(src), pa.array(dst)], names=["kind", "key", "src", "dst"])

    held = [np.empty(0, np.int64)] * 3
    hot = None
    for b in batches:
        rows = [b.column(c).to_numpy() for c in range(3)]
        if hot is not None:
            same = link.bucket(rows[0]) == hot
            if same.any():
                yield out(1, *(r[same] for r in rows))
                rows = [r[~same] for r in rows]
        if not len(rows[0]):
            continue
        hot = None
        rows = [np.concatenate(pair) for pair in zip(held, rows)]
        bucket = link.bucket(rows[0])
        last = int(np.searchsorted(bucket, bucket[-1]))
        if last:
            yield links_of(*(r[:last] for r in rows))
        held = [r[last:] for r in rows]
        if len(held[0]) > block:
            hot = bucket[-1]
            yield out(1, *held)
            held = [r[:0] for r in held]
    if len(held[0]):
        yield links_of(*held)


def _block_pair(t: pa.Table, link: _Chains) -> pa.Table:
    side = t["side"].to_numpy()
    by = np.argsort(side, kind="stable")
    key, chain, ids = (t[c].to_numpy()[by] for c in ("key", "src", "dst"))
    first = int((side == 0).sum())
    label = _inside(link, key, chain) if first == len(by) else _across(link, key, chain, first)
    src, dst = _star(label, ids)
    return pa.table({"src": src, "dst": dst})


def links(keys: DataFrame, low: int, budget: tuple[int, ...], block: int = BLOCK) -> DataFrame:
    """Links ``(src, dst)`` between key rows, as stars a component and bucket: they join what the pairs within budget join."""
    link = _Chains(low, budget)
    bucket = F.shiftright("key", low)
    found = common.cut(keys.repartition(bucket).sortWithinPartitions("key").mapInArrow(partial(common.released, step=partial(_met, link=link, block=block)), "kind int, key long, src long, dst long"))
    plain = found.filter("kind = 0").select("src", "dst")
    # of a hot bucket src is the chain, dst the id
    hot = found.filter("kind = 1").select(bucket.alias("bucket"), "key", "src", "dst")
    count = hot.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = hot.join(count, "bucket").withColumn("own", F.pmod(F.xxhash64("dst"), F.col("n")).cast("int"))
    # every pair of blocks of a hot bucket is one group of at most about two blocks
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "bucket", "key", "src", "dst", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))

    def compare(t: pa.Table) -> pa.Table:
        return _block_pair(t, link)

    far = paired.groupBy("bucket", "i", "j").applyInArrow(compare, "src long, dst long")
    # a row has at most one link a table (and block): its least one stays, the others join the smallest ids themselves
    stars = common.cut(plain.union(far).groupBy("dst").agg(F.min("src").alias("src"), F.collect_set("src").alias("all")))
    return stars.select("src", "dst").union(stars.select("src", F.explode("all").alias("dst")).filter("src <> dst").distinct())


def exact_links(classes: DataFrame, tau: int = 3, segments: int = 8, block: int = BLOCK) -> DataFrame:
    """Links between 64-bit fingerprints ``(id, fp)`` of ``tau`` or fewer differing bits."""
    if segments != 8:
        raise ValueError("chains are checked byte by byte")
    keys = classes.mapInArrow(partial(_exact_keys, tables=exact_tables(tau, segments), size=64 // segments), _KEYS)
    return links(keys, 0, tuple(n * tau // segments for n in range(1, segments + 1)), block)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, tau: int = 3, block: int = BLOCK) -> DataFrame:
    """``(id, fp, component)`` for every row of ``df``."""
    fp = common.cut(fingerprints(df, id_col, text_col, width))
    classes = fp.groupBy("fp").agg(F.min("id").alias("id"))
    comp = common.connected(exact_links(classes.filter("id is not null").select("id", "fp"), tau, block=block))
    named = classes.join(comp, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component"))
    return fp.join(named, "fp")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, 64 bits, at most 3 differing bits."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---- five-word shingles at a Jaccard similarity ----------------------------------------------

#: Bits of the transform, of a key, of a chain behind it; keys a ring; share of differing bits that chains may have.
SIZE, KEY, CHAIN, TABLES = 4096, 20, 96, 201
RATE = 0.19
_RING = KEY * TABLES
_BUDGET = tuple(math.floor((KEY + 8 * n) * RATE) for n in range(1, CHAIN // 8 + 1))


def _ring_keys(batches):
    """Key rows of every fingerprint (id, fp): segment number and 20 bits, then 96 bits of chain in the key's rest and ``chain``."""
    at = np.arange(TABLES) * KEY
    window = (at // 8)[:, None] + np.arange(16)
    shift = (at % 8).astype(np.uint64)
    table = (np.arange(TABLES, dtype=np.uint64) << np.uint64(KEY + 32))[None]
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)[:, :_RING]
            ring = np.packbits(np.concatenate((bits, bits[:, : 8 * 20]), axis=1), axis=1)
            two = np.ascontiguousarray(ring[:, window]).view(">u8").astype(np.uint64)
            high = (two[:, :, 0] << shift) | np.where(shift > 0, two[:, :, 1] >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            low = two[:, :, 1] << shift
            # 20 bits of key and 32 of chain, then 12 and 52 of chain
            key = table | (high >> np.uint64(12))
            chain = (high << np.uint64(52)) | (low >> np.uint64(12))
            ids = np.repeat(part.column(0).to_numpy(), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(chain.ravel().view(np.int64)), pa.array(ids)], names=["key", "chain", "id"])


def _alike(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sets with a Jaccard similarity of ``least`` or more.

    Every pair is decided: by the exact similarity, by a link of its two groups, or
    because it shares none of its rarest elements, one of which it must share.
    """
    size = np.array([len(x) for x in sets])
    label, out = np.arange(len(sets)), []

    def join(i, j):
        a, b = sorted((label[i], label[j]))
        label[label == b] = a
        out.append((int(i), int(j)))

    empty = np.flatnonzero(size == 0)
    for i in empty[1:]:
        join(empty[0], i)
    if len(empty) == len(sets):
        return out
    _, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    single, ends = int((count == 1).sum()), np.cumsum(size)
    first = []
    for n, end in zip(size.tolist(), ends.tolist()):
        r = np.sort(rank[flat[end - n : end]])[: n - math.ceil(least * n - 1e-6) + 1]
        first.append(r[r >= single])
    held = np.concatenate(first)
    who = np.repeat(np.arange(len(sets)), [len(r) for r in first])
    order = np.argsort(held, kind="stable")
    held, who = held[order], who[order]
    for i in range(len(sets)):
        near = np.zeros(len(sets), bool)
        for lo, hi in zip(np.searchsorted(held, first[i]), np.searchsorted(held, first[i], "right")):
            near[who[lo:hi]] = True
        near &= (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-6) & (label != label[i])
        for j in np.flatnonzero(near[:i]):
            if label[j] != label[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (size[i] + size[j] - both):
                    join(j, i)
    return out


def _compared(batches, width: int, least: float):
    """Links within each group of rows ``(g, id, text)``, which come sorted by ``g``."""
    for t in common.keyed_groups(batches, "g"):
        g, ids, texts = t["g"].to_numpy(), t["id"].to_numpy(), t["text"]
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        src, dst = [], []
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            if b - a > 1:
                found = _alike(shingle_sets(texts.slice(a, b - a).to_pylist(), width), least)
                src += [ids[a + i] for i, _ in found]
                dst += [ids[a + j] for _, j in found]
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _exact_links(src: DataFrame, named: DataFrame, edges: DataFrame, width: int, least: float, block: int) -> DataFrame:
    """All links of ``least`` within the components of the candidate ``edges``, as spanning forests.

    Members of a component of more than ``block`` texts, or more than ``SHINGLES``
    shingles, meet as pairs of blocks.
    """
    comp = common.cut(common.connected(edges).select(F.col("node").alias("id"), F.col("component").alias("c")))
    size = F.col("n") if "n" in named.columns else F.lit(0)
    ends = comp.join(named.select(F.col("rep").alias("id"), "t", size.alias("size")), "id")
    large = ends.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / SHINGLES)).cast("int").alias("n")).filter("n > 1")
    ends = ends.drop("size").join(large, "c", "left")
    held = src.join(ends, ["id", "t"]).dropDuplicates(["id"]).withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "id", "text")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(partial(common.released, step=partial(_compared, width=width, least=least)), "src long, dst long")


def _rings(batches, width: int):
    for b in common.slices(batches, 2):
        sets = shingle_sets(b.column(2).to_pylist(), width)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches(sets, SIZE), pa.binary())], names=["id", "t", "n", "fp"])


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, block: int = TEXTS) -> DataFrame:
    """``(rep, t, component)``, a row a distinct text: smallest id and digest of the text, and its group.

    Groups hold texts whose ``width``-word shingle sets have a Jaccard similarity of
    ``least`` or more, and whatever such links reach.  Candidates are pairs of
    fingerprints with an equal key and chains within budget; within each component of
    the candidates all pairs are then decided exactly on whole texts.  A pair of just
    0.8 is a candidate with a probability above 0.99 (201 keys), more similar ones almost
    surely; keys, chains and budgets never depend on the table.  Null texts and texts
    without words are one group.
    """
    text = F.col(f"`{text_col}`").cast("string")
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("t"), text.alias("text"))
    rings = src.mapInArrow(partial(common.released, step=partial(_rings, width=width)), "id long, t binary, n long, fp binary")
    rows = common.cut(rings.groupBy("t").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    named = rows.filter("rep is not null")
    edges = common.cut(links(named.select("rep", "fp").mapInArrow(partial(common.released, step=_ring_keys), _KEYS), 32, _BUDGET).distinct())
    comp = common.connected(_exact_links(src, named, edges, width, least, block))
    return rows.select("rep", "t").join(comp, F.col("rep") == F.col("node"), "left").select("rep", "t", F.coalesce("component", "rep").alias("component"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stand for their group: smallest id, one row an id (a text found with null ids only keeps one row)."""
    keep = similar_texts(df, id_col, text_col, **options).filter("rep is null or rep = component").select("rep", F.col("t").alias("kept"))
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_t": F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))})
    out = rows.join(keep, (F.col("_t") == F.col("kept")) & F.col("_id").eqNullSafe(F.col("rep"))).dropDuplicates(["_id", "_t"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
