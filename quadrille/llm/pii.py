"""Operator 8: personal data with a skip-chain conditional random field.

Base spans are the contract's patterns.  On top of them a conditional random
field labels every token that holds a digit or an at sign (other tokens are
observed as plain text).  Neighbouring tokens share chain potentials; all mentions
of a token, and all tokens with the same digits, share skip potentials with one hub
of the document, so any two mentions are two steps apart, however many lie between.
Loopy sum-product message passing runs in each document until its messages stand
still (at most 100 rounds and one more a node), whatever shares its batch.  Tokens
inside base spans are observed; confident labels elsewhere become further spans.

Weights are fitted by pseudo-likelihood on a bounded sample of texts, labelled
by the base patterns: ``TRAIN_DOCS`` texts of at most ``TRAIN_CHARS`` characters
with the smallest hash.  Everything else covers all rows and whole texts.

Defined results: null and empty texts have no spans; offsets are code points;
repeated rows are scanned each; an empty table gives an empty result (and
untrained weights); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS = 2000, 20_000
_LABELS = 1 + len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Starts inside a run of digits can never succeed where the run's first digit fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[^\s]*[0-9@][^\s]*")
_SOME = re.compile("[0-9@]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    back = digits[::-1]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if not _SOME.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# ---- the random field -------------------------------------------------------------------------


def _features(token: str) -> list[float]:
    d = _digits(token)
    n, dots = len(d), token.count(".")
    letters = any(c.isalpha() for c in token)
    core = token.strip(".,;:!?\"'#$%&*|")
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    tel = bool(re.fullmatch(r"[0-9]{3}[-. ]?[0-9]{4}|\([0-9]{3}\)|\+[0-9]{1,3}", core))
    return [1.0, "@" in token and letters and dots > 0, "@" in token, quad, tel, 16 <= n <= 19 and not letters, 16 <= n <= 19 and luhn(d), letters,
            n == 0, 0 < n < 3, 3 <= n < 5, 5 <= n < 8, 8 <= n < 13, 13 <= n < 16, n > 19, dots == 3, "-" in core, "+" in core, "=" in token or '"' in token, len(token) > 60]


N_FEATURES = len(_features("x"))


@dataclass
class Field:
    """Weights: unary (label, feature), chain (left label, right label), skip (label) for equal labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Graph:
    """Nodes of several documents with observed labels (-1: open), chain and skip edges.

    Tokens come first, then the hubs of repeated tokens, which have no features.
    ``pairs`` joins each mention with the one before it, for fitting.
    """

    doc: list[int]
    span: list[tuple[int, int]]
    x: np.ndarray
    seen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    pairs: np.ndarray


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    doc, span, x, seen, chain, mentions = [], [], [], [], [], {}
    for number, (text, base) in enumerate(zip(texts, bases)):
        if not _SOME.search(text):
            continue
        marks = sorted((a, z, kind) for kind, a, z in base)
        at, end = 0, -1
        for m in _NODE.finditer(text):
            a, z = m.span()
            while at < len(marks) and marks[at][1] <= a:
                at += 1
            here = len(doc)
            doc.append(number)
            span.append((a, z))
            x.append(_features(m[0]))
            seen.append(marks[at][2] + 1 if at < len(marks) and marks[at][0] < z else -1)
            if end >= 0 and not text[end:a].strip():
                chain.append((here - 1, here))
            end = z
            same = m[0].strip(".,;:!?\"'#$%&*|").lower()
            digits = "".join(c for c in same if "0" <= c <= "9")
            mentions.setdefault((number, digits if len(digits) > 3 else f"={same}"), []).append(here)
    skip, pairs = [], []
    for (number, _), nodes in mentions.items():
        if len(nodes) > 1:
            skip += [(node, len(doc)) for node in nodes]
            pairs += zip(nodes, nodes[1:])
            doc.append(number)
    hubs = len(doc) - len(span)
    two = lambda e: np.array(e, np.int64).reshape(-1, 2)
    features = np.concatenate((np.array(x, float).reshape(-1, N_FEATURES), np.zeros((hubs, N_FEATURES))))
    return Graph(doc, span, features, np.array(seen + [-1] * hubs, np.int64), two(chain), two(skip), two(pairs))


def _normal(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=-1, keepdims=True)


def fit(texts: list[str], steps: int = 300, rate: float = 1.0, decay: float = 1e-3) -> Field:
    """Maximum pseudo-likelihood with base patterns as labels; deterministic."""
    g = graph(texts, [base_spans(t) for t in texts])
    w = Field(np.zeros((_LABELS, N_FEATURES)), np.zeros((_LABELS, _LABELS)), np.zeros(_LABELS))
    w.unary[0, 0] = 2.0
    n = len(g.span)
    if not n:
        return w
    x, y = g.x[:n], np.maximum(g.seen[:n], 0)
    one = np.eye(_LABELS)
    left, right, skip = np.zeros((n, _LABELS)), np.zeros((n, _LABELS)), np.zeros((n, _LABELS))
    np.add.at(left, g.chain[:, 1], one[y[g.chain[:, 0]]])
    np.add.at(right, g.chain[:, 0], one[y[g.chain[:, 1]]])
    np.add.at(skip, g.pairs[:, 0], one[y[g.pairs[:, 1]]])
    np.add.at(skip, g.pairs[:, 1], one[y[g.pairs[:, 0]]])
    for _ in range(steps):
        p = _normal(x @ w.unary.T + left @ w.chain + right @ w.chain.T + skip * w.skip)
        miss = (one[y] - p) / n
        w.unary += rate * (miss.T @ x - decay * w.unary)
        w.chain += rate * (left.T @ miss + miss.T @ right - decay * w.chain)
        w.skip += rate * ((skip * miss).sum(axis=0) - decay * w.skip)
    # a repeated mention speaks for its label, never against it; from mention to mention it is two steps, over the hub
    w.skip = 2 * np.maximum(w.skip, 0.5)
    return w


def beliefs(g: Graph, w: Field, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product, all messages of a document at once, with damping; observed nodes are fixed.

    A document stops when none of its messages moves by 1e-4, or after ``rounds`` (100 and its nodes).
    """
    unary = g.x @ w.unary.T
    known = g.seen >= 0
    unary[known] = -30.0
    unary[known, g.seen[known]] = 30.0
    edges = np.concatenate((g.chain, g.skip))
    if not len(edges):
        return _normal(unary)
    doc = np.array(g.doc)
    most = np.bincount(doc) + 100 if rounds is None else np.full(doc.max() + 1, rounds)
    pot = np.concatenate((np.broadcast_to(w.chain, (len(g.chain), _LABELS, _LABELS)), np.broadcast_to(np.diag(w.skip), (len(g.skip), _LABELS, _LABELS))))
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    pot = np.concatenate((pot, pot.transpose(0, 2, 1)))
    half = len(edges)
    back = np.concatenate((np.arange(half) + half, np.arange(half)))
    msg = np.zeros((2 * half, _LABELS))
    at, turn = np.arange(2 * half), 0
    while len(at):
        turn += 1
        total = unary.copy()
        np.add.at(total, dst[at], msg[at])
        inner = (total[src[at]] - msg[back[at]])[:, :, None] + pot[at]
        top = inner.max(axis=1)
        new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = np.zeros(len(most))
        np.maximum.at(moved, doc[src[at]], np.abs(new - msg[at]).max(axis=1))
        msg[at] = 0.5 * msg[at] + 0.5 * new
        going = (moved >= 1e-4) & (turn < most)
        at = at[going[doc[src[at]]]]
    total = unary
    np.add.at(total, dst, msg)
    return _normal(total)


def all_spans(texts: list[str], w: Field, sure: float = 0.9) -> list[tuple[list, list]]:
    """For each text: (base spans, all spans), each (kind number, start, end) by kind, then start."""
    bases = [base_spans(t) for t in texts]
    g = graph(texts, bases)
    out = [(b, list(b)) for b in bases]
    if len(g.x):
        p = beliefs(g, w)
        label = p.argmax(axis=1)
        label[(p.max(axis=1) < sure) | (g.seen >= 0)] = 0
        label[len(g.span) :] = 0
        joined = {tuple(e) for e in g.chain.tolist()}
        for i in np.flatnonzero(label).tolist():
            text, (a, z), kind = texts[g.doc[i]], g.span[i], int(label[i]) - 1
            token = text[a:z]
            a += len(token) - len(token.lstrip(".,;:!?\"'#$%&*|([{"))
            z -= len(token) - len(token.rstrip(".,;:!?\"'#$%&*|)]}"))
            spans = out[g.doc[i]][1]
            if (i - 1, i) in joined and label[i - 1] == label[i] and spans and spans[-1][0] == kind and spans[-1][2] <= a:
                spans[-1] = (kind, spans[-1][1], z)
            elif a < z:
                spans.append((kind, a, z))
        for _, spans in out:
            spans.sort()
    return out


def _found(batches, w: Field):
    for b in common.slices(batches, 1):
        texts = [t or "" for t in b.column(1).to_pylist()]
        rows = []
        for base, spans in all_spans(texts, w):
            say = lambda s: ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in s)
            rows.append((*(sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5])], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def train(df: DataFrame, text_col: str = "text", docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """Fit on at most ``docs`` distinct texts with digits or at signs, smallest hash first."""
    text = F.col(f"`{text_col}`").cast("string")
    some = df.select(text.alias("text")).filter((F.length("text") <= chars) & F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    # the hash of the last text taken, then the texts up to it: only bounded samples leave the executors
    last = some.select("h").distinct().orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    rows = some.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["h"])])


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row."""
    field = train(df, text_col) if field is None else field
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return src.mapInArrow(partial(_found, w=field), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _masked(batches, w: Field, at: int):
    for b in common.slices(batches, at):
        texts = b.column(at).to_pylist()
        out = []
        for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], w)):
            if text is not None:
                parts, end = [], 0
                for a, z, kind in sorted((a, z, k) for k, a, z in spans):
                    if z > end:
                        parts += [text[end : max(a, end)], f"[{KINDS[kind]}]"]
                        end = z
                text = "".join(parts) + text[end:] if parts else text
            out.append(text)
        yield b.set_column(at, b.schema.names[at], pa.array(out, pa.string()))


def masked(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; other columns pass through."""
    field = train(df, text_col) if field is None else field
    return df.mapInArrow(partial(_masked, w=field, at=df.columns.index(text_col)), df.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
