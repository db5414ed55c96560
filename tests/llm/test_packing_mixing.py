import itertools
import random
from collections import defaultdict

import pytest

from quadrille.llm import mixing, packing


def padding(lengths, tops):
    return sum(min(t for t in tops if t >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(0, 14) for _ in range(40)]
    cells = sorted(set(lengths))
    tops = packing.boundaries(cells, [lengths.count(c) for c in cells], [c * lengths.count(c) for c in cells], 4)
    best = min(padding(lengths, [*c, cells[-1]]) for n in range(4) for c in itertools.combinations(cells[:-1], n))
    assert len(tops) <= 4 and padding(lengths, tops) == best


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_are_optimal_at_all_lengths(seed):
    """Against the plain dynamic program, with lengths far above a thousand."""
    rng = random.Random(seed)
    lengths = [int(rng.lognormvariate(6, 2)) for _ in range(400)]
    cells = sorted(set(lengths))
    count = [lengths.count(c) for c in cells]
    assert cells[-1] > 20_000
    c, total = [0], [0]
    for length, k in zip(cells, count):
        c.append(c[-1] + k)
        total.append(total[-1] + length * k)
    best = [0.0] + [float("inf")] * len(cells)
    for _ in range(7):
        best = [0.0] + [min(best[i] + cells[j] * (c[j + 1] - c[i]) - (total[j + 1] - total[i]) for i in range(j + 1)) for j in range(len(cells))]
    tops = packing.boundaries(cells, count, [c * k for c, k in zip(cells, count)], 7)
    assert len(tops) <= 7 and padding(lengths, tops) == best[-1]


def test_given_lengths_and_shared_cells(spark):
    rows = [(i, f"t{i}", None if i == 3 else (-4 if i == 4 else 17 * i * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    exact = packing.packed(df, buckets=5, length_col="size").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in exact} == {i: max(0, n or 0) for i, _, n in rows}
    shared = packing.packed(df, buckets=5, length_col="size", cells=40).collect()
    assert len(shared) == 300 and all(0 <= r["n_tokens"] <= r["padded_to"] for r in shared)
    assert sum(r["padding"] for r in exact) <= sum(r["padding"] for r in shared) <= 1.3 * sum(r["padding"] for r in exact)


def plain_boundaries(lengths, count, buckets):
    """Whole numbers, one length at a time; of equal costs the earliest start of a bucket."""
    c, total = [0], [0]
    for length, k in zip(lengths, count):
        c.append(c[-1] + k)
        total.append(total[-1] + length * k)
    n = len(lengths)
    best, layers = [0] + [lengths[j] * c[j + 1] - total[j + 1] for j in range(n)], []
    for _ in range(min(buckets, n) - 1):
        pairs = [min((best[i] + lengths[j] * (c[j + 1] - c[i]) - (total[j + 1] - total[i]), i) for i in range(j + 1)) for j in range(n)]
        best = [0] + [cost for cost, _ in pairs]
        layers.append([i for _, i in pairs])
    tops, end = [lengths[-1]], layers[-1][-1] - 1 if layers else -1
    for layer in [*reversed(layers[:-1]), None]:
        if end < 0:
            break
        tops.append(lengths[end])
        end = layer[end] - 1 if layer else -1
    return tops[::-1]


@pytest.mark.parametrize("seed", range(40))
def test_boundaries_do_not_depend_on_pieces(seed):
    """Ties, lengths beyond 2^53 and any number of lengths searched at once."""
    rng = random.Random(seed)
    scale = rng.choice([1, 1, 10**15, 10**17])
    lengths = sorted({scale * rng.randint(0, rng.choice([60, 300])) for _ in range(rng.randint(1, 60))})
    count = [rng.choice([1, 1, 2, 10 ** rng.randint(0, 8)]) for _ in lengths]
    want = plain_boundaries(lengths, count, 6)
    for cells in (1, 3, 17, packing.CELLS):
        assert packing.boundaries(lengths, count, None, 6, cells) == want


def test_batches_do_not_depend_on_the_number_of_lengths(spark):
    df = spark.createDataFrame([(i, f"t{i}", i * i % 7919) for i in range(400)], "doc_id long, text string, size long")
    whole = packing.packed(df, buckets=5, length_col="size").collect()
    lengths = sorted({r["n_tokens"] for r in whole})
    assert len(lengths) > 300
    assert sorted({r["padded_to"] for r in whole}) == plain_boundaries(lengths, [sum(r["n_tokens"] == n for r in whole) for n in lengths], 5)
    for cells in (1, 40):
        assert sorted(packing.packed(df, buckets=5, length_col="size", cells=cells).collect()) == sorted(whole)


def test_batches_hold_the_budget(docs, odd):
    rows = [*odd, *((100 + i, "w " * (i % 37), "en", "s") for i in range(200))]
    out = packing.packed(docs(rows).drop("bucket"), buckets=4, budget=100).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for r in out:
        assert 0 <= r["n_tokens"] <= r["padded_to"] and r["padding"] == r["padded_to"] - r["n_tokens"]
        groups[r["batch_id"]].append(r)
    for g in groups.values():
        assert len({r["bucket"] for r in g}) == 1 and sorted(r["slot"] for r in g) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g[0]["padded_to"] <= 100
    assert packing.packed(docs([]).drop("bucket")).count() == 0


def brute_seats(w, total, most):
    a = [0] * len(w)
    for _ in range(total):
        open_ = [i for i in range(len(w)) if a[i] < most[i]]
        if not open_:
            break
        a[max(open_, key=lambda i: (w[i] / (2 * a[i] + 1), -i))] += 1
    return a


@pytest.mark.parametrize("seed", range(6))
def test_seats_follow_the_highest_quotients(seed):
    rng = random.Random(seed)
    w = [rng.choice([rng.random() * 100, 7.0, 14.0]) for _ in range(9)]
    most = [rng.choice([3, 50, 1000]) for _ in w]
    for total in (1, 5, 40, 333):
        assert mixing.seats(w, total, most).tolist() == brute_seats(w, total, most)


def test_mixture_meets_its_targets(docs, odd):
    rng = random.Random(3)
    rows = [*odd, *((1000 + i, "w " * rng.randint(0, 300), "en", rng.choice(["s0", "s1", "s2", "s2", "s2", "s2"])) for i in range(400))]
    out = mixing.mix(docs(rows)).collect()
    assert out and len(out) == len(rows)
    again = mixing.mix(docs(list(reversed(rows)))).collect()
    assert sorted(map(tuple, map(repr, out))) == sorted(map(tuple, map(repr, again)))
    size, goal, taken = defaultdict(int), {}, defaultdict(int)
    names = {r[0]: r[3] for r in rows if r[0] != 6}
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        if r["id"] in names:
            s = names[r["id"]]
            goal[s] = (r["target"], r["source_size"])
            taken[s] += r["taken"]
            size[s] += r["size"]
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - goal[s][0]) <= 48
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: next(x["source_size"] for x in out if names.get(x["id"], 0) == s) for s in order if s in names.values()}
    want = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        assert goal[s][0] == pytest.approx(t) and t <= 3 * sizes[s] + 1e-9
    assert sum(want) == pytest.approx(sum(sizes.values()))
    text = {r["doc_id"]: r["text"] for r in mixing.mixed(docs(rows)).collect() if r["doc_id"] != 6}
    for r in out:
        if r["id"] != 6 and r["id"] is not None:
            assert len((text.get(r["id"]) or "").split()) == r["taken"] or r["id"] == 5
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
