import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import nearest


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float((np.array(v, np.float64) * np.array(vectors[q], np.float64)).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = scored[:k]
    return out


def run(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int")
    got = {}
    for r in nearest.search(df, queries=F.col("id") % 3 == 0, k=k, **kw).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return got


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = {i: [float(x) for x in rng.standard_normal(16).astype(np.float32)] for i in range(300)}
    for i in range(200, 260):
        good[i] = good[7]
    bad = [(900, None), (903, [0.0] * 16), (906, [None] + [1.0] * 15), (909, [float("nan")] * 16), (912, [float("inf")] * 16), (915, [1.0, 2.0])]
    rows = [(i, v, "x", 1) for i, v in [*good.items(), *bad, (None, good[1])]]
    got = run(spark, rows, block=64)
    want = brute(good, [i for i in good if i % 3 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        assert [(-s, i) for i, s in (ranks[r] for r in sorted(ranks))] == sorted((-s, i) for i, s in ranks.values())
        hits += len({i for i, _ in ranks.values()} & {i for _, i in want[q]})
    assert hits >= 0.99 * 5 * len(want)


@pytest.mark.parametrize("size", [1e19, 1e20, 1e30, 3e38])
def test_very_long_and_very_short_vectors(spark, size):
    rng = np.random.default_rng(9)
    good = {i: [float(x) for x in rng.standard_normal(16).astype(np.float32)] for i in range(120)}
    for i, f in ((3, size), (40, size / 7), (41, -size), (60, 1e-30)):
        good[i] = [float(np.float32(x / 4 * f)) for x in good[i]]
    got = run(spark, [(i, v, "x", 1) for i, v in good.items()], block=32)
    want = brute(good, [i for i in good if i % 3 == 0], 5)
    assert set(got) == set(want)
    for q, ranks in got.items():
        assert [ranks[r][1] for r in sorted(ranks)] == pytest.approx([-s for s, _ in want[q]], rel=1e-9)


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    for dim in (3, 16, 50, 64):
        vectors, queries = rng.standard_normal((500, dim)), rng.standard_normal((20, dim))
        centre, turn = vectors.mean(axis=0), nearest.rotation(dim, 4)
        estimate, error = nearest.Codes.of(vectors, centre, turn).bounds(queries, centre, turn, 4.0)
        assert (np.abs(estimate - queries @ vectors.T) <= error + 1e-9).mean() > 0.999


def test_few_candidates_and_empty(spark):
    got = run(spark, [(0, [1.0, 2.0], "x", 1), (3, [2.0, 1.0], "x", 1), (4, [5.0, 5.0], "x", 1)])
    assert {q: [v for _, v in sorted((r, i) for r, (i, _) in x.items())] for q, x in got.items()} == {0: [4, 3], 3: [4, 0]}
    assert run(spark, []) == {}


def test_recall_on_the_test_table(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = nearest.search(df, queries=F.col("id") % 20 == 0).collect()
    hits = sum((r["vec_id"] in {i for _, i in want[r["query_id"]]}) for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.99 * len(got)
