"""Operator 6: media columns in archives, read by a custom data source.

``store`` writes every text as a lossless picture (8-bit RGB samples, 64 pixels a
row) into archives: members one after the other, then a directory (id, offset,
length, check sum) and a footer.  Each task writes archives of its own name and
reports them as rows; a task that is run again leaves an archive that no row names.

``ArchiveSource`` plans byte ranges over the named archives, reads the directory
of each, takes the members that begin in its range, retries each member by its
own offset, and streams payloads as Arrow batches of bounded size.

Defined results: a null text is empty; payloads are padded with spaces to a
positive multiple of 192 bytes; repeated rows are members each; an empty table
gives an empty result; extra columns are ignored; a member that cannot be read
after all retries fails the task, so that Spark runs it again.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 192
_MAGIC = b"QMEDIA1\n"
#: Bytes of members in one planned partition, of payload in one Arrow batch, and of one archive.
SPLIT, BATCH, ARCHIVE = 32 << 20, 8 << 20, 256 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """Portable network graphics: 8-bit RGB, 64 pixels a row, no row filter."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH // 3, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """Samples of a picture written by ``encode``; check sums are verified."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a picture")
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("row filters are not used")
    return raw[:, 1:].tobytes()


class _Archive:
    """Sequential writer: members, directory, footer."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = pafs.FileSystem.from_uri(uri)
        self.out, self.at, self.entries = fs.open_output_stream(path), 0, []

    def add(self, key: int | None, n_bytes: int, media: bytes) -> None:
        self.entries.append((key, n_bytes, self.at, len(media), zlib.crc32(media)))
        self.out.write(media)
        self.at += len(media)

    def close(self) -> tuple[str, int, int]:
        names = ("id", "n_bytes", "offset", "length", "crc")
        table = pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*self.entries))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        body = zlib.compress(sink.getvalue(), 1)
        self.out.write(body)
        self.out.write(struct.pack("<QQ", self.at, len(body)) + _MAGIC)
        self.out.close()
        return self.uri, len(self.entries), self.at


def _written(batches, folder: str):
    archive = None
    done = []
    for b in common.slices(batches, 1):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            payload = data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))
            if archive is None:
                archive = _Archive(f"{folder}/{uuid.uuid4().hex}.arc")
            archive.add(key, len(data), encode(payload))
            if archive.at >= ARCHIVE:
                done.append(archive.close())
                archive = None
    if archive is not None:
        done.append(archive.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "members", "bytes"])


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write archives below ``folder``; ``(archive, members, bytes)`` of those that count."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return common.cut(src.mapInArrow(partial(_written, folder=folder), "archive string, members long, bytes long"))


class Range(InputPartition):
    def __init__(self, archive: str, first: int, end: int):
        self.archive, self.first, self.end = archive, first, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.listing = options["listing"]
        self.split = int(options.get("split", SPLIT))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        fs, path = pafs.FileSystem.from_uri(self.listing)
        with fs.open_input_stream(path) as f:
            archives = json.loads(f.read())
        return [Range(name, a, min(size, a + self.split)) for name, size in archives for a in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        fs, path = pafs.FileSystem.from_uri(partition.archive)
        rows, held, handle = [], 0, []
        for key, n_bytes, offset, length, crc in self._members(fs, path, partition):
            media, tries = self._member(fs, path, offset, length, crc, handle)
            payload = decode(media)
            rows.append((key, n_bytes, offset, tries, media, payload))
            held += len(payload) + len(media)
            if held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        for f in handle:
            f.close()
        if rows:
            yield self._batch(rows)

    def _members(self, fs, path, partition):
        with fs.open_input_file(path) as f:
            size = f.size()
            f.seek(size - 24)
            tail = f.read(24)
            if tail[16:] != _MAGIC:
                raise ValueError(f"{path} is not an archive")
            at, n = struct.unpack("<QQ", tail[:16])
            f.seek(at)
            table = pa.ipc.open_stream(zlib.decompress(f.read(n))).read_all()
        offset = table["offset"].to_numpy()
        a, z = np.searchsorted(offset, (partition.first, partition.end))
        return zip(*(table[c].slice(a, z - a).to_pylist() for c in ("id", "n_bytes", "offset", "length", "crc")))

    def _member(self, fs, path, offset, length, crc, handle=None):
        """One member by its offset; ``handle`` keeps the archive open for all of a range, each retry opens it anew."""
        handle = [] if handle is None else handle
        for attempt in range(1, self.retries + 2):
            try:
                if not handle:
                    handle.append(fs.open_input_file(path))
                handle[0].seek(offset)
                media = handle[0].read(length)
                if len(media) != length or zlib.crc32(media) != crc:
                    raise OSError(f"member at {offset} of {path} is damaged")
                return media, attempt
            except OSError:
                if handle:
                    handle.pop().close()
                if attempt > self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)

    @staticmethod
    def _batch(rows):
        key, n_bytes, offset, tries, media, payload = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(offset, pa.int64()), pa.array(tries, pa.int32()), pa.array(media, pa.binary()), pa.array(payload, pa.binary())], names=["id", "n_bytes", "offset", "tries", "media", "payload"])


class ArchiveSource(DataSource):
    """``spark.read.format("quadrille_archive").option("listing", uri).load()``"""

    @classmethod
    def name(cls):
        return "quadrille_archive"

    def schema(self):
        return "id long, n_bytes long, offset long, tries int, media binary, payload binary"

    def reader(self, schema):
        return _Reader(self.options)


def load(spark: SparkSession, archives: DataFrame, folder: str, **options) -> DataFrame:
    """Members of the archives, as rows of ``ArchiveSource``."""
    listing = f"{folder}/{uuid.uuid4().hex}.json"
    fs, path = pafs.FileSystem.from_uri(listing)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(sorted([r["archive"], r["bytes"]] for r in archives.select("archive", "bytes").collect())).encode())
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).options(listing=listing, **options).load()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy (bits) of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    mean = float(p @ np.arange(256))
    dev = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean * mean)))
    q = p[p > 0]
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};dev={dev:.4f};bits={max(0.0, float(-(q * np.log2(q)).sum())):.4f}"


def _described(batches):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for b in batches:
        media, payload = b.column(2).to_pylist(), b.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(p) for p in payload], pa.int64()), pa.array([sha(p) for p in payload], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
             pa.array([len(m) for m in media], pa.int64()), pa.array([sha(m) for m in media], pa.string()), pa.array([feature(p) for p in payload], pa.string())],
            names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def described(members: DataFrame) -> DataFrame:
    """Digests and features of members, from the bytes read back."""
    return members.select("id", "n_bytes", "media", "payload").mapInArrow(_described, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "media")
    archives = store(common.table(spark, sf_dir, "documents"), folder)
    return described(load(spark, archives, folder)).withColumnRenamed("id", "doc_id")
