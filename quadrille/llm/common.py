"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir
from ..operators.graph import connected

__all__ = ["WORD", "connected", "cut", "digits", "joined", "keyed_groups", "only", "released", "scratch", "shared_dir", "slices", "table"]

#: Characters that separate words (ASCII white space), as used by every word-based operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files that results are read from while the session lasts; it goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)

    def clear() -> None:
        with contextlib.suppress(OSError):
            fs.delete_dir(path)

    atexit.register(clear)
    return folder


def only(df: DataFrame, **columns) -> DataFrame:
    """Project to fresh names first, so extra or clashing input columns never matter."""
    return df.select(*[F.col(f"`{c}`").alias(new) if isinstance(c, str) else c.alias(new) for new, c in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of one text column (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0))
        group = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key``: tables that never split a key (each is about one batch, or one key if that is larger)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        if held and k[-1] == np.asarray(held[-1].column(key))[-1]:
            held.append(batch)
            continue
        at = 0 if k[0] == k[-1] else int(len(k) - np.argmax(k[::-1] != k[-1]))
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def joined(seed: int, *parts: Column) -> Column:
    """The seed and the parts as one binary text with bars between them, nulls empty."""
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")


def digits(key: Column | str, at: int) -> Column:
    """15 hexadecimal digits of ``key`` as a number; other engines can do the same with md5."""
    return F.conv(F.substring(key, at, 15), 16, 10).cast("long")


def released(batches, step):
    """``step(batches)``; what it held goes back to the system, as an idle Python worker would keep it through later stages."""
    yield from step(batches)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
