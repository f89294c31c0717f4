import random

from twinspan.llm.components import connected_groups
from twinspan.work import Workspace


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def groups(spark, edges):
    df = spark.createDataFrame([(a, b, 0, "") for a, b in edges], "a bigint, b bigint, v int, p string")
    rows = connected_groups(df, "a", "b", Workspace(spark, "t")).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["group_id"] for r in rows}


def test_shapes(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, 2000 + k) for k in range(80)]
    shuffled = list(range(5000, 5040))
    random.Random(2).shuffle(shuffled)
    chain = list(zip(shuffled, shuffled[1:]))
    odd = [(7000, 7000), (None, 1), (2, None), (8001, 8000), (8000, 8001), (8000, 8001), (-5, -9)]
    edges = path + star + chain + odd
    assert groups(spark, edges) == brute(edges)


def test_random(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)]
    assert groups(spark, edges) == brute(edges)


def test_empty(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(1, 1), (None, None)]) == {}
