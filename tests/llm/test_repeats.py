import hashlib
import random

import pytest

from quadrille.llm import repeats


def brute(rows, length):
    data = [(1 << 62 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs, rows, length=50, gram=16):
    got = repeats.without_repeats(docs(rows), length=length, gram=gram).collect()
    assert sorted((1 << 62 if r["id"] is None else r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows, length)


@pytest.mark.parametrize("length,gram", [(50, 16), (40, 12)])
def test_matches_brute_force(docs, length, gram):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(25)]
    rows = [(rng.randint(0, 40), "".join(rng.choice(pool)[: rng.randint(1, 200)] for _ in range(rng.randint(0, 6))), "en", "s") for _ in range(60)]
    rows += [(100 + i, "x" * (40 + 5 * i), "en", "s") for i in range(8)] + [(90, "ab" * 60, "en", "s"), (91, "b" + "ab" * 60, "en", "s"), (None, pool[0] * 2, "en", "s")]
    check(docs, rows, length, gram)


def test_odd_rows(docs, odd):
    check(docs, [r if r[1] is None else (r[0], r[1][:3000], *r[2:]) for r in odd])


def test_empty(docs):
    assert repeats.without_repeats(docs([])).count() == 0
