import random

from mnemograph.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_matches_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(500, 500 + i) for i in range(40)] + [(None, 3), (4, None), (9, 9)] + [(1, 2)] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
