import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import common, shingles, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text, width=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, tau):
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, f) in enumerate(items):
        for j, g in items[:a]:
            if (f ^ g).bit_count() <= tau:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


def test_matches_brute_force_and_odd_rows(docs, odd):
    rows = [r for r in odd if r[0] is not None]
    rows += [(20 + i, f"some quite common words stand here again and again number {i // 3} end", "en", "s") for i in range(30)]
    out = simhash.near_duplicates(docs(rows + [odd[7]])).collect()
    got = {(r["id"], int.from_bytes(r["fp"], "big")): r["component"] for r in out if r["id"] is not None}
    assert len(out) == len(rows) + 1
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    assert set(got) == set(fps)
    want = brute_components(fps, 3)
    assert all(c == want[i] for (i, _), c in got.items())
    # a null id joins the class of its text
    assert [r["component"] for r in out if r["id"] is None] == [7]


@pytest.mark.parametrize("block", [3, 4096])
def test_hot_buckets_lose_no_link(spark, block):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 63))
    fps = {centre}
    while len(fps) < 60:
        f = centre
        for b in rng.integers(0, 64, size=int(rng.integers(1, 5))):
            f ^= 1 << int(b)
        fps.add(f)
    items = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in items], "id long, fp binary")
    got = {r["node"]: r["component"] for r in common.connected(simhash.exact_links(df, 3, block=block)).collect()}
    want = brute_components(items, 3)
    assert {i: got.get(i, i) for i, _ in items} == want


def test_every_close_pair_shares_a_table_key():
    tables = simhash.exact_tables(3)
    rng = np.random.default_rng(2)
    for _ in range(3000):
        x = int(rng.integers(1 << 63)) * 2 + int(rng.integers(2))
        y = x
        for b in rng.integers(0, 64, size=3):
            y ^= 1 << int(b)
        hit = False
        for start, free, (lo, hi) in tables:
            d = x ^ y
            d = ((d << start * 8) | (d >> (64 - start * 8))) & (1 << 64) - 1
            chain = [(d >> (64 - 8 * n)).bit_count() <= 3 * n // 8 for n in range(1, 9)]
            hit |= d >> (64 - free * 8) == 0 and (d >> (64 - hi)) & ((1 << (hi - lo)) - 1) == 0 and all(chain)
        assert hit


def test_similar_texts_keeps_one_of_each_group(docs, odd):
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60", "changed")
    far = " ".join(f"v{i}" for i in range(120))
    rows = [*odd, (30, near, "en", "s"), (31, base, "en", "s"), (32, base, "en", "s"), (33, far, "en", "s")]
    kept = simhash.deduplicated(docs(rows)).select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None and i >= 30) == [30, 33]
    assert sorted(i for i in ids if i is not None and i < 30) == [1, 4, 5, 7, 8, 9]
    assert None not in ids


def brute_groups(texts, least=0.8, width=5):
    """Smallest position of each text's group, by comparing all pairs of shingle sets."""

    def shingles(text):
        words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets, label = [shingles(x) for x in texts], list(range(len(texts)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if len(x & y) >= least * len(x | y) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    return label


def variants(seed, count, changes, length=400):
    """Texts that differ from a common one in some words, so that many pairs lie around the threshold."""
    rng = np.random.default_rng(seed)
    for k in range(count):
        words = [f"s{seed}w{i}" for i in range(length)]
        for i in rng.choice(length, size=changes[k % len(changes)], replace=False):
            words[i] = f"k{k}c{i}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [7, 1024])
def test_thinned_candidates_lose_no_link(spark, block):
    """Candidates only form a path; links beside the path count all the same."""
    texts = [*variants(1, 60, (5, 6, 7)), *variants(2, 30, (4, 5))]
    want = brute_groups(texts)
    assert len(set(want)) == 40
    src = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "id long, t long, text string")
    path = spark.createDataFrame([(i, i + 1) for i in range(len(texts) - 1)], "src long, dst long")
    found = simhash._exact_links(src, src.select(F.col("id").alias("rep"), "t"), path, 5, 0.8, block)
    got = {r["node"]: r["component"] for r in common.connected(found).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def similar(docs, texts, **options):
    out = simhash.similar_texts(docs([(i, x, "en", "s") for i, x in enumerate(texts)]), **options).collect()
    got = {r["rep"]: r["component"] for r in out}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("block", [7, 1024])
def test_large_group_around_the_threshold(docs, block):
    texts = [*variants(1, 60, (5, 6, 7)), *variants(2, 30, (4, 5))]
    want = brute_groups(texts)
    assert 3 < len(set(want)) < 60
    assert similar(docs, texts, block=block) == want


def test_repeated_lines_count_once(docs):
    """Shingle sets decide: how often a line or a word repeats does not matter."""
    body, line = " ".join(f"b{i}" for i in range(500)), " ".join(f"r{i}" for i in range(14))
    texts = [f"{body} {line}", f"{body} " + " ".join([line] * 300), "na " * 400 + "end of it", "na " * 300 + "end of it", "na " * 400 + " ".join(f"z{i}" for i in range(40))]
    want = brute_groups(texts)
    assert want == [0, 0, 2, 2, 4]
    assert similar(docs, texts) == want


def test_every_pair_at_the_threshold_is_found(docs):
    """Isolated pairs of a similarity of 0.80 to 0.82, and hot shingles in large buckets."""
    rng = np.random.default_rng(5)
    texts = []
    for p in range(60):
        words = [f"p{p}w{i}" for i in range(int(rng.integers(100, 400)))]
        cut = int((len(words) - 4) * 0.8 + 1) + 4
        texts += [" ".join(words), " ".join(words[:cut])]
    same = [f"c{i}" for i in range(60)]
    texts += [" ".join([*same, *(f"h{k}x{i}" for i in range(1 + k % 9))]) for k in range(40)]
    want = brute_groups(texts)
    assert want[:120] == [i - i % 2 for i in range(120)]
    assert similar(docs, texts) == want


def test_keys_do_not_depend_on_the_table():
    """A text has the same key rows alone and among others, so a pair links at any table size."""
    texts = [f"text {i} " + " ".join(f"w{i * j % 97}" for j in range(60)) for i in range(700)] + [None, "", "a b"]

    def keys(some):
        fps = shingles.sketches(shingles.shingle_sets(some, 5), simhash.SIZE)
        out = list(simhash._ring_keys([pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(fps, pa.binary())], names=["id", "fp"])]))
        return np.concatenate([np.column_stack([c.to_numpy() for c in b.columns[:2]]) for b in out]).reshape(len(some), simhash.TABLES, 2)

    every = keys(texts)
    for i in (0, 5, 350, 699, 700, 701, 702):
        assert (keys(texts[i : i + 1])[0] == every[i]).all()
    # a key row is 20 + 96 consecutive bits of the ring
    fp = np.unpackbits(np.frombuffer(shingles.sketches(shingles.shingle_sets(texts[:1], 5), simhash.SIZE)[0], np.uint8))[: simhash._RING]
    ring = "".join(map(str, fp.tolist())) * 2
    for s in range(simhash.TABLES):
        key, chain = (int(x) for x in every[0, s].view(np.uint64))
        assert key >> 52 == s
        assert f"{key & (1 << 52) - 1:052b}{chain:064b}" == ring[20 * s : 20 * s + 116]


def test_shingle_sets_agree_with_brute_force():
    texts = ["", None, "one", "One  two\tthree", "a b c d e f a b c d e f", "x" * 3000 + " y z w v " + "x" * 3000, "é ö ü ß 中 文 " * 5, " lead and trail "]
    texts += [" ".join(f"w{i % 7}" for i in range(k)) for k in range(3, 40)]
    sets = shingles.shingle_sets(texts, 5)
    seen = {}
    for text, got in zip(texts, sets):
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(got) == len(want) and (np.diff(got.view(np.int64).astype(object)) != 0).all()
        assert set(got.tolist()) == {int(shingles.shingle_sets([" ".join(s)], 5)[0][0]) for s in want}
        for s in want:
            assert seen.setdefault(int(shingles.shingle_sets([" ".join(s)], 5)[0][0]), s) == s


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.deduplicated(docs([])).count() == 0
