"""Verifiers: predictions against recomputed truth, records against their contract."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def verified(expected: Column, predicted: Column, how: str) -> Column:
    """STRUCT<correct, score, expected, predicted>; ``how``: upper or title case of the trimmed prediction."""
    said = F.upper(F.trim(predicted)) if how == "upper" else F.initcap(F.lower(F.trim(predicted)))
    ok = F.coalesce(said == expected, F.lit(False))
    return F.struct(ok.alias("correct"), F.when(ok, 1.0).otherwise(-1.0).alias("score"), expected.alias("expected"), said.alias("predicted"))


def _leaves(value, at: tuple = ()) -> dict[tuple, tuple]:
    """Path -> (sort, value) of every scalar and every empty or closed container of a JSON value."""
    if isinstance(value, dict):
        inner = [((*at, key), part) for key, part in value.items()]
        out = {at: ("object", len(inner))}
    elif isinstance(value, list):
        inner = [((*at, n), part) for n, part in enumerate(value)]
        out = {at: ("list", len(inner))}
    else:
        sort = "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "null" if value is None else "text"
        return {at: (sort, value)}
    for path, part in inner:
        out |= _leaves(part, path)
    return out


def _agree(said: str | None, true: str | None, tolerance: float) -> bool:
    try:
        a, b = _leaves(json.loads(said)), _leaves(json.loads(true))
    except (TypeError, ValueError, RecursionError):
        return False
    if a.keys() != b.keys():
        return False
    for path, (sort, value) in a.items():
        other_sort, other = b[path]
        if sort != other_sort or sort == "null":
            return False
        if value != other and not (sort == "number" and abs(value - other) <= tolerance):
            return False
    return True


def answer_matches(predicted: Column, gold: Column, tolerance: float = 1e-3) -> Column:
    """JSON values of one shape and one sort a place: numbers within tolerance, flags, texts and list orders equal; a null agrees with nothing."""

    @F.pandas_udf("boolean")
    def agree(said: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([_agree(a, b, tolerance) for a, b in zip(said, true)])

    return agree(predicted, gold)


def scene_kept(message: Column, scene: Column) -> Column:
    """The message begins with the program's scene and asks something."""
    head = F.concat(F.lit("Question:\n"), scene, F.lit("\n\nQuery: "))
    return F.startswith(message, head) & (F.trim(F.substr(message, F.length(head) + 1)) != "")


def facts_present(message: Column, fragments: Column) -> Column:
    return F.forall(fragments, lambda f: F.contains(message, f))


def evidence(style: Column, text: Column, fragments: Column) -> Column:
    """A trace must state its facts before the act; bare answers have no trace."""
    before = F.substring_index(text, "\n\nAct:\n", 1)
    return (style == "qa") | F.forall(fragments, lambda f: F.contains(before, f))


def two_messages(messages: Column) -> Column:
    """One user and one assistant message with content."""
    return (F.size(messages) == 2) & (F.get(messages, 0)["role"] == "user") & (F.get(messages, 1)["role"] == "assistant") & (F.trim(F.get(messages, 1)["content"]) != "")
