"""Components of random graphs, a long path and a star, against union-find."""

import random

from vellum.llm.components import components


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(5)
    path = list(range(1000, 1120))
    r.shuffle(path)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + list(zip(path, path[1:], strict=False)) + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7), (9000, 8999), (8999, 9000)]
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == union_find(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
