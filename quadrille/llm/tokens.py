"""Operator 2: token counts from distinct pre-tokens.

Documents are read once, in chunks of bounded size.  A chunk keeps its distinct
pre-tokens in one list and each document's pre-token frequencies as positions
into that list.  All chunk lists meet in one shuffle by pre-token hash bucket,
where every distinct pre-token is given to the tokenizer exactly once; the
resulting piece counts return to their chunk and are summed against the frequencies.  No token
id sequence of a document is ever built.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result; extra columns are
ignored; a text of any length is one document.
"""

from __future__ import annotations

import json
import marshal
import os
import re
import zlib
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The pre-tokenizer's published pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: Up to here the pattern's character classes are the same in every Unicode version; other texts use the library's own splitter.
_PLAIN = re.compile("[^\x00-ɏ]")
#: Bytes of text in a chunk (a longer single text is a chunk of its own).
CHUNK = 8 << 20

#: Rows of documents (freq) and of a chunk's pre-tokens in one hash bucket (pieces, positions from ``first``).
_SCHEMA = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("freq", pa.binary()), ("bucket", pa.int32()), ("first", pa.int32()), ("pieces", pa.binary())])
_SQL = "chunk long, id long, n_bytes long, special long, freq binary, bucket int, first int, pieces binary"


@lru_cache(maxsize=4)
def _library(path: str):
    """(tokenizer that treats special strings as text and splits nothing, its own splitter, pattern of special strings)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("pre-token counting needs a byte-level tokenizer without normalizer or prefix space")
    added = [t for t in spec.get("added_tokens", [])]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("special tokens that strip or match whole words only are not supported")
    splitter = own.pre_tokenizer
    single = Tokenizer.from_file(path)
    single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    single.encode_special_tokens = True
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    return single, splitter, re.compile("|".join(map(re.escape, names))) if names else None


def split(text: str, splitter) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if not _PLAIN.search(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]


def _counted(batches, path: str, chunk_bytes: int, buckets: int):
    _, splitter, special = _library(path)
    part = TaskContext.get().partitionId()
    for seq, b in enumerate(common.slices(batches, 1, chunk_bytes)):
        chunk, local, rows = (part << 32) | seq, {}, []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            parts = special.split(text) if special else [text]
            count = Counter(split(parts[0], splitter))
            for p in parts[1:]:
                count.update(split(p, splitter))
            pos = np.fromiter((local.setdefault(p, len(local)) for p in count), np.int32, len(count))
            times = np.fromiter(count.values(), np.int64, len(count)).astype("<u4")
            rows.append((i, len(text.encode("utf-8", "surrogatepass")), len(parts) - 1, pos, times))
        # positions follow the buckets, so a bucket's pieces are one run
        words = list(local)
        home = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int32, len(words))
        order = sorted(range(len(words)), key=lambda k: (home[k], words[k]))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        blobs = []
        for *_, pos, times in rows:
            at = place[pos]
            by = np.argsort(at)
            blobs.append(zlib.compress(np.diff(at[by], prepend=0).astype("<u4").tobytes() + times[by].tobytes(), 1))
        n = len(rows)
        ids, sizes, extra = ([r[k] for r in rows] for k in range(3))
        none = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(extra, pa.int64()), pa.array(blobs, pa.binary()), none, none, pa.nulls(n, pa.binary())], schema=_SCHEMA)
        runs = np.flatnonzero(np.diff(home[order], prepend=-1)).tolist() if words else []
        packed = [zlib.compress(marshal.dumps([words[k] for k in order[a:z]]), 1) for a, z in zip(runs, [*runs[1:], len(words)])]
        n = len(runs)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), none, none, none, pa.nulls(n, pa.binary()), pa.array([int(home[order[a]]) for a in runs], pa.int32()), pa.array(runs, pa.int32()), pa.array(packed, pa.binary())], schema=_SCHEMA)


def _piece_counts(batches, path: str):
    """Whole hash buckets: each distinct piece is encoded once."""
    single, _, _ = _library(path)
    known: dict[str, int] = {}
    for b in batches:
        out = []
        for blob in b.column(2).to_pylist():
            words = marshal.loads(zlib.decompress(blob))
            new = [w for w in words if w not in known]
            if new:
                known.update(zip(new, (len(e.ids) for e in single.encode_batch(new, add_special_tokens=False))))
            out.append(zlib.compress(np.array([known[w] for w in words], "<u4").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["chunk", "first", "sizes"])


def _summed(t: pa.Table) -> pa.Table:
    """One chunk: piece counts by position, and documents with frequencies."""
    is_doc = pc.is_valid(t["freq"])
    counts, docs = t.filter(pc.invert(is_doc)), t.filter(is_doc)
    runs = sorted(zip(counts["first"].to_pylist(), counts["sizes"].to_pylist()))
    size = np.concatenate([np.frombuffer(zlib.decompress(s), "<u4") for _, s in runs]).astype(np.int64) if runs else np.zeros(0, np.int64)
    out = []
    for blob, special in zip(docs["freq"].to_pylist(), docs["special"].to_pylist()):
        f = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
        k = len(f) // 2
        out.append(int(size[np.cumsum(f[:k])] @ f[k:]) + special if k else special)
    return pa.table({"id": docs["id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(out, pa.int64())})


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row, as the tokenizers library counts a text without added special tokens."""
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = common.cut(src.mapInArrow(partial(_counted, path=path, chunk_bytes=chunk_bytes, buckets=buckets), _SQL))
    pieces = counted.filter("pieces is not null").repartition(buckets, "bucket").select("chunk", "first", "pieces")
    sized = pieces.mapInArrow(partial(_piece_counts, path=path), "chunk long, first int, sizes binary")
    docs = counted.filter("freq is not null").select("chunk", "id", "n_bytes", "special", "freq", F.lit(None).cast("int").alias("first"), F.lit(None).cast("binary").alias("sizes"))
    none = F.lit(None)
    back = sized.select("chunk", none.cast("long").alias("id"), none.cast("long").alias("n_bytes"), none.cast("long").alias("special"), none.cast("binary").alias("freq"), "first", "sizes")

    def total(t: pa.Table) -> pa.Table:
        return _summed(t)

    return docs.union(back).groupBy("chunk").applyInArrow(total, "id long, n_bytes long, n_tokens long")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: byte_bpe_50k.json, limit 1024."""
    import public_tokenizers

    out = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
