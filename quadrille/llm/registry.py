"""Queries of the training-data operators."""

from __future__ import annotations

from . import langid, media, mixing, nearest, oracles, packing, pii, repeats, secrets, simhash, tokens


def queries():
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_tokens": tokens.op2_tokens,
        "op3_repeats": repeats.op3_repeats,
        "op4_nearest": nearest.op4_nearest,
        "op5_packing": packing.op5_packing,
        "op6_media": media.op6_media,
        "op7_secrets": secrets.op7_secrets,
        "op8_pii": pii.op8_pii,
        "op9_mixing": mixing.op9_mixing,
        "op10_language": langid.op10_language,
    }


def oracle_sql():
    return dict(oracles.SQL)
