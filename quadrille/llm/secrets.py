"""Operator 7: secret scan with one combined deterministic automaton.

Base rules are those of the contract; further rules (hosted-git tokens, signed
web tokens, chat tokens, private-key headers) add spans of their own kinds.
Lengths are checked after matching, so a match that is too short still uses up
its text, as a leftmost non-overlapping search does.

Defined results: null and empty texts have no spans; offsets are code points;
repeated rows are scanned each; an empty table gives an empty result; extra
columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .automaton import Automaton, Rule

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base rules first, in the contract's order.  A hexadecimal run shorter than 16 never counts, so the rule starts at 16.
RULES = [
    Rule("assign", _ASSIGN, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("git", r"gh[opsur]_[A-Za-z0-9]+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
BASE = ("assign", "access", "hex")
LEAST = {"access": 18, "hex": 16, "git": 40, "jwt": 40, "chat": 15, "key": 0}
_VALUE = re.compile(_ASSIGN.encode(), re.IGNORECASE)


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(RULES)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, sorted."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = []
    for rule, a, b in automaton().scan(data):
        kind = RULES[rule].kind
        if kind == "assign":
            if len(_VALUE.fullmatch(data, a, b)[2]) < 12:
                continue
        elif b - a < LEAST[kind]:
            continue
        out.append((a, rule, b))
    out.sort()
    if out and not data.isascii():
        first = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        out = [(int(first[a]) - 1, r, int(first[b - 1])) for a, r, b in out]
    return out


def _scanned(batches):
    for b in common.slices(batches, 1):
        rows = []
        for text in b.column(1).to_pylist():
            found = [(RULES[r].kind, a, z) for a, r, z in spans(text)]
            base = ",".join(f"{k}:{a}:{z}" for k, a, z in found if k in BASE)
            count = [sum(k == kind for k, _, _ in found) for kind in BASE]
            rows.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{z}" for k, a, z in found)))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row."""
    src = common.only(df, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    return src.mapInArrow(_scanned, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
