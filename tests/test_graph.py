"""Components against union-find, hubs included."""

import random

from quadrille.operators import graph


def _components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_of_hubs_chains_and_noise(spark):
    r = random.Random(4)
    hub = [(5000, x) for x in range(5001, 5600)] + [(x, 9000) for x in range(8000, 8500)]
    chain = [(x, x + 7) for x in range(100, 800, 7)]
    noise = [(r.randrange(10_000, 10_400), r.randrange(10_000, 10_400)) for _ in range(180)]
    edges = hub + chain + noise + chain[:20] + [(3, 3), (-4, 2), (2, -9)]
    r.shuffle(edges)
    got = graph.connected(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len({x["node"] for x in got})
    assert {x["node"]: x["component"] for x in got} == _components(edges)


def test_components_without_edges(spark):
    assert graph.connected(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
