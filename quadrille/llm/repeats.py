"""Operator 3: repeated byte strings removed by distributed prefix doubling.

A byte goes if a string of ``length`` bytes covering it also starts in a document
with a smaller id.  Strings get names of growing length, and only positions whose
name is still shared between documents go on:

1. ``gram`` bytes: every string has a content-defined anchor (the smallest gram
   hash inside it), so only anchors are named; Spark deals them out by that name
   and each bucket sorts (name, context) pairs.  Anchors alone in their document
   drop out; a run of strings whose whole context equals that of a smaller
   document is past the threshold at once.
2. about ``length - 8`` bytes: in the same buckets, pairs of half-length names at
   four offsets around the anchor; runs that stay shared go on.
3. ``length`` bytes: the remaining positions are named by their two overlapping
   halves, dealt out and sorted again; the smallest document of each name decides.

Texts are kept once, compressed, in archive files of the shared folder, in slices
of about ``SLICE`` bytes; everything that is shuffled is a packed column block of
one slice.  Within a slice equal contexts are resolved first, so a hot passage
sends one entry a slice.

Defined results: null texts are empty; texts shorter than ``length`` keep all;
repeats inside one document, or between rows of one id, stay; a null id counts as
the largest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import marshal
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .anchors import _mix, window_argmin, window_hash

SLICE = 4 << 20
_LAST = np.iinfo(np.int64).max


def _save(**columns) -> bytes:
    """Packed columns: names (64-bit unsigned) as they are, offsets (32-bit unsigned) as steps, all but the names compressed."""
    head, raw, rest = [], [], []
    for k, v in columns.items():
        head.append((k, v.dtype.str, len(v)))
        if v.dtype == np.uint64:
            raw.append(v.tobytes())
        else:
            rest.append((np.diff(v, prepend=np.uint32(0)) if v.dtype == np.uint32 else v).tobytes())
    body = zlib.compress(marshal.dumps(head) + b"".join(rest), 1)
    return len(body).to_bytes(8, "little") + body + b"".join(raw)


def _open(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    rest = io.BytesIO(zlib.decompress(blob[8 : 8 + n]))
    head, raw, out = marshal.load(rest), 8 + n, {}
    for k, dtype, size in head:
        if dtype == "<u8":
            out[k] = np.frombuffer(blob, np.uint64, size, raw)
            raw += 8 * size
        else:
            v = np.frombuffer(rest.read(np.dtype(dtype).itemsize * size), dtype)
            out[k] = np.cumsum(v, dtype=np.uint32) if dtype == "<u4" else v
    return out


class _Names:
    """Names of strings in one slice: a buffer of documents, one after the other."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.gram = length, gram
        self.half = (length + gram) // 2
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        self.halves = window_hash(self.buf, self.half) if len(self.buf) >= length else np.empty(0, np.uint64)

    def _at(self, i: np.ndarray) -> np.ndarray:
        return self.halves[np.clip(i, 0, len(self.halves) - 1)]

    def runs(self):
        """Runs of string starts with one anchor: first start, last start, anchor, gram name."""
        w = self.length
        if len(self.buf) < w:
            z = np.empty(0, np.int64)
            return z, z, z, np.empty(0, np.uint64)
        h = window_hash(self.buf, self.gram)
        at = window_argmin(h, w - self.gram + 1)
        n = len(at)
        inside = self.owner[:n] == self.owner[w - 1 : w - 1 + n]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (self.owner[1:n] != self.owner[: n - 1])) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [n - 1]))
        keep = inside[first]
        first, last = first[keep].astype(np.int64), last[keep].astype(np.int64)
        anchor = at[first].astype(np.int64)
        return first, last, anchor, h[anchor]

    def context(self, first, last, anchor) -> np.ndarray:
        """Name of all bytes of a run, with the run's place around its anchor."""
        gap = self.length - self.half
        ends = _mix(_mix(self._at(first), self._at(first + gap)), _mix(self._at(last), self._at(last + gap)))
        return _mix(ends, ((anchor - first) * 4096 + last - first).astype(np.uint64))

    def around(self, anchor, behind: int, reach: int) -> np.ndarray:
        """Name of the bytes from ``behind`` before the anchor, ``half + reach`` long."""
        return _mix(self._at(anchor - behind), self._at(anchor - behind + reach))

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._at(at), self._at(at + self.length - self.half)
        return _mix(a, b), (_mix(b, a) >> np.uint64(32)).astype(np.uint32)


def _zones(length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(smallest, largest distance of a string start before its anchor; bytes before the anchor, reach beyond a half) of the second names.

    A string with such a distance contains all bytes of the zone's name.
    """
    half, room = (length + gram) // 2, length - gram
    cuts = [0, room // 4, room // 2, 3 * room // 4, room]
    # a string at distance d covers [anchor - d, anchor - d + length)
    return [(a, z, a, length - z + a - half) for a, z in zip(cuts, cuts[1:])]


def _anchored(batches, folder: str, length: int, gram: int, buckets: int):
    # a partition that is computed again writes the same bytes under the same name
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{TaskContext.get().partitionId()}.slices")
    draft = f"{path}.{uuid.uuid4().hex}"
    out, at = None, 0
    zones = _zones(length, gram)
    for b in common.slices(batches, 1, SLICE):
        if out is None:
            out = fs.open_output_stream(draft)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        ids = b.column(0)
        order = np.asarray(ids.fill_null(_LAST)).astype(np.int64)
        names = _Names(texts, length, gram)
        first, last, anchor, g = names.runs()
        doc = names.owner[first] if len(first) else np.empty(0, np.int32)
        x = names.context(first, last, anchor) if len(first) else np.empty(0, np.uint64)
        rank = order[doc]
        # equal contexts inside the slice: only the smallest document's go on
        by = np.lexsort((rank, x, g))
        gs, xs, rs = g[by], x[by], rank[by]
        new = np.concatenate(([True], (gs[1:] != gs[:-1]) | (xs[1:] != xs[:-1])))[: len(by)]
        least = rs[new][np.cumsum(new) - 1] if len(by) else rs
        gone = np.zeros(len(first), bool)
        gone[by] = rs > least
        own = first - names.start[doc]
        blob = _slice_blob(b, own[gone], (last - first)[gone] + 1, doc[gone])
        out.write(blob)
        home = f"{path}:{at}:{len(blob)}"
        at += len(blob)
        keep = np.flatnonzero(~gone)
        first, last, anchor, g, x, doc, own = (v[keep] for v in (first, last, anchor, g, x, doc, own))
        cols = []
        if len(keep):
            bucket = (g % np.uint64(buckets)).astype(np.int64)
            near = [(names.around(anchor, behind, reach) >> np.uint64(48)) for _, _, behind, reach in zones]
            one = (g >> np.uint64(16) << np.uint64(16)) | near[0]
            two = (x >> np.uint64(16) << np.uint64(16)) | near[1]
            three = ((near[2] << np.uint64(16)) | near[3]).astype(np.uint32)
            by = np.argsort(bucket, kind="stable")
            edge = np.concatenate((np.flatnonzero(np.diff(bucket[by], prepend=-1)), [len(by)]))
            for a, z in zip(edge, edge[1:]):
                s = by[a:z]
                docs, local = np.unique(doc[s], return_inverse=True)
                cols.append((int(bucket[s[0]]), _save(one=one[s], two=two[s], three=three[s], docs=docs.astype(np.int32), order=order[docs], doc=local.astype(np.uint16 if len(docs) < 65536 else np.int32), first=own[s].astype(np.uint32), n=(last - first)[s].astype(np.uint8), d=(anchor - first)[s].astype(np.uint8))))
        cols.append((-1, None))  # every slice has a row, whatever it holds
        yield pa.RecordBatch.from_arrays([pa.array([home] * len(cols)), pa.array([c[0] for c in cols], pa.int32()), pa.array([c[1] for c in cols], pa.binary())], names=["slice", "bucket", "data"])
    if out is not None:
        out.close()
        fs.move(draft, path)


def _slice_blob(b: pa.RecordBatch, own, n, doc) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    gone = _save(first=own.astype(np.uint32), n=n.astype(np.uint8), doc=doc.astype(np.int32))
    body = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
    return len(body).to_bytes(8, "little") + body + gone


def _read_slice(folder: str, home: str) -> tuple[pa.Table, dict]:
    """Documents of a slice, and the runs already known to go."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    path, at, n = home.rsplit(":", 2)
    with fs.open_input_file(path) as f:
        f.seek(int(at))
        data = f.read(int(n))
    size = int.from_bytes(data[:8], "little")
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])).read_all(), _open(data[8 + size :])


def _spread(keys: list[np.ndarray], value: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry: least and largest ``value`` among the used entries with equal keys."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        s = k[by]
        new[1:] |= s[1:] != s[:-1]
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    low, high = np.where(use, value, _LAST)[by], np.where(use, value, np.iinfo(np.int64).min)[by]
    a, b = np.empty_like(value), np.empty_like(value)
    a[by] = np.minimum.reduceat(low, at)[group]
    b[by] = np.maximum.reduceat(high, at)[group]
    return a, b


def _by_key(batches, column: str):
    """Batches sorted by a column: (key, rows as lists) with no key split."""
    key, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row[column] != key:
                if held:
                    yield key, held
                key, held = row[column], []
            held.append(row)
    if held:
        yield key, held


_FOUND = "slice string, sure boolean, data binary"


def _found(home: list[str], part: np.ndarray, sure: bool, **columns):
    """One packed row a slice."""
    by = np.argsort(part, kind="stable")
    edge = np.concatenate((np.flatnonzero(np.diff(part[by], prepend=-1)), [len(by)])) if len(by) else [0]
    return [(home[int(part[by[a]])], sure, _save(**{k: v[by[a:z]] for k, v in columns.items()})) for a, z in zip(edge, edge[1:])]


def _rows(rows, names):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=names)


def _bucketed(batches, length: int, gram: int):
    """First and second names: runs that go for sure, and runs that stay shared."""
    zones = _zones(length, gram)
    for _, rows in _by_key(batches, "bucket"):
        blocks = [_open(r["data"]) for r in rows]
        part = np.repeat(np.arange(len(blocks)), [len(x["one"]) for x in blocks])
        one, two, three, first, n, d = (np.concatenate([x[k] for x in blocks]) for k in ("one", "two", "three", "first", "n", "d"))
        rank = np.concatenate([x["order"][x["doc"]] for x in blocks])
        doc = np.concatenate([x["docs"][x["doc"]] for x in blocks])
        del blocks
        g = one >> np.uint64(16)
        a, b = _spread([g], rank, np.ones(len(g), bool))
        keep = np.flatnonzero(a < b)
        if not len(keep):
            continue
        part, one, two, three, first, n, d, rank, doc, g = (v[keep] for v in (part, one, two, three, first, n, d, rank, doc, g))
        x = two >> np.uint64(16)
        a, _ = _spread([g, x], rank, np.ones(len(g), bool))
        gone = rank > a
        n, d = n.astype(np.int64), d.astype(np.int64)
        # strings of a run start at distances d - n .. d before the anchor
        low, high = np.full(len(g), 1 << 20), np.full(len(g), -1)
        for (near, far, _, _), name in zip(zones, (one & np.uint64(65535), two & np.uint64(65535), three >> np.uint32(16), three & np.uint32(65535))):
            hit = ~gone & (d >= near) & (d - n <= far)
            a, b = _spread([g, name], rank, hit)
            hit &= a < b
            low = np.where(hit, np.minimum(low, np.maximum(near, d - n)), low)
            high = np.where(hit, np.maximum(high, np.minimum(far, d)), high)
        open_ = ~gone & (high >= low)
        home = [r["slice"] for r in rows]
        out = _found(home, part[gone], True, first=first[gone], n=(n[gone] + 1).astype(np.uint8), doc=doc[gone])
        start = first[open_].astype(np.int64) + d[open_] - high[open_]
        out += _found(home, part[open_], False, first=start.astype(np.uint32), n=(high - low + 1)[open_].astype(np.uint8), doc=doc[open_])
        if out:
            yield _rows(out, ["slice", "sure", "data"])


def _positions(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, start) of packed runs."""
    first, n, doc = (np.concatenate([x[k] for x in blocks]).astype(np.int64) for k in ("first", "n", "doc"))
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = np.unique(np.repeat(doc, n) << 32 | at)
    return key >> 32, key & 0xFFFFFFFF


def _named(batches, folder: str, length: int, gram: int, buckets: int):
    """Third names of the remaining positions of each slice."""
    for home, rows in _by_key(batches, "slice"):
        docs, _ = _read_slice(folder, home)
        number, at = _positions([_open(r["data"]) for r in rows])
        some, local = np.unique(number, return_inverse=True)
        text = docs.column(1).take(pa.array(some))
        order = np.asarray(docs.column(0).combine_chunks().fill_null(_LAST)).astype(np.int64)[some]
        names = _Names([(t or "").encode("utf-8", "surrogatepass") for t in text.to_pylist()], length, gram)
        w, v = names.strings(names.start[local] + at)
        bucket = (w % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edge = np.concatenate((np.flatnonzero(np.diff(bucket[by], prepend=-1)), [len(by)]))
        out = [(int(bucket[by[a]]), _save(w=w[s], v=v[s], order=order[local[s]], doc=number[s].astype(np.int32), first=at[s].astype(np.uint32))) for a, z in zip(edge, edge[1:]) for s in [by[a:z]]]
        yield pa.RecordBatch.from_arrays([pa.array([home] * len(out)), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["slice", "bucket", "data"])


def _decided(batches):
    for _, rows in _by_key(batches, "bucket"):
        blocks = [_open(r["data"]) for r in rows]
        part = np.repeat(np.arange(len(blocks)), [len(x["w"]) for x in blocks])
        w, v, order, doc, first = (np.concatenate([x[k] for x in blocks]) for k in ("w", "v", "order", "doc", "first"))
        a, _ = _spread([w, v], order, np.ones(len(w), bool))
        gone = order > a
        out = _found([r["slice"] for r in rows], part[gone], True, first=first[gone], n=np.ones(int(gone.sum()), np.uint8), doc=doc[gone])
        if out:
            yield _rows(out, ["slice", "sure", "data"])


def _spans(first: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of one document."""
    by = np.argsort(first, kind="stable")
    a, z = first[by], (first + n - 1 + length)[by]
    reach = np.maximum.accumulate(z)
    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
    return list(zip(a[np.concatenate(([0], cut))].tolist(), reach[np.concatenate((cut - 1, [len(a) - 1]))].tolist()))


def _finished(batches, folder: str, length: int, texts: bool):
    for home, rows in _by_key(batches, "slice"):
        docs, known = _read_slice(folder, home)
        blocks = [known, *(_open(r["data"]) for r in rows if r["data"] is not None)]
        first, n, doc = (np.concatenate([x[k] for x in blocks]).astype(np.int64) for k in ("first", "n", "doc"))
        by = np.argsort(doc, kind="stable")
        first, n, doc = first[by], n[by], doc[by]
        out = []
        for i, text in enumerate(docs.column(1).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            a, z = np.searchsorted(doc, (i, i + 1))
            spans = _spans(first[a:z], n[a:z], length) if z > a else []
            kept, end = [], 0
            for s, e in spans:
                kept.append(data[end:s])
                end = e
            kept = b"".join(kept) + data[end:]
            out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None))
        size, gone, runs, sha, kept = zip(*out)
        yield pa.RecordBatch.from_arrays([docs.column(0).combine_chunks(), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, texts: bool = True) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row; ``kept`` holds the remaining bytes (null without ``texts``)."""
    if not 8 <= gram <= length - 16 or length > 240:
        raise ValueError("needs 8 <= gram <= length - 16 and length <= 240")
    spark = df.sparkSession
    folder = common.scratch(spark, "repeats")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    opts = {"length": length, "gram": gram}
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    block = "slice string, bucket int, data binary"
    dealt = src.mapInArrow(partial(_anchored, folder=folder, buckets=buckets, **opts), block).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    # a slice's own row (bucket -1) passes through
    first = common.cut(dealt.mapInArrow(partial(_sorted_names, **opts), _FOUND))
    open_ = first.filter("not sure").repartition(buckets // 2, "slice").sortWithinPartitions("slice")
    named = open_.mapInArrow(partial(_named, folder=folder, buckets=buckets, **opts), block)
    last = named.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_decided, _FOUND)
    gone = first.filter("sure or sure is null").union(last).repartition(buckets // 2, "slice").sortWithinPartitions("slice")
    return gone.mapInArrow(partial(_finished, folder=folder, length=length, texts=texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _sorted_names(batches, length: int, gram: int):
    """Rows of bucket -1 name the slices; all other buckets are sorted."""
    def rest():
        for b in batches:
            here = np.asarray(b.column(1)) < 0
            if here.any():
                own.append(b.filter(pa.array(here)).column(0))
            yield b.filter(pa.array(~here)) if here.any() else b

    own: list = []
    yield from _bucketed(rest(), length, gram)
    for names in own:
        n = len(names)
        yield pa.RecordBatch.from_arrays([names, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], names=["slice", "sure", "data"])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: strings of 50 bytes."""
    return without_repeats(common.table(spark, sf_dir, "documents"), texts=False).drop("kept").withColumnRenamed("id", "doc_id")
