import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from twinspan.llm.packing import packed, placed, planned, token_counts
from twinspan.work import Workspace


def naive(sizes, capacity):
    left = []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(left) if r >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(capacity - size)
    return sorted(left)


def containers(sizes, capacity):
    """What the plan puts into each container."""
    plan, used = planned(Counter(x for x in sizes if x), capacity)
    seen, filled = Counter(), Counter()
    ranks = []
    for size in sizes:
        ranks.append(seen[size])
        seen[size] += 1
    at = placed(plan, used, np.array(sizes, dtype=np.int64), np.array(ranks, dtype=np.int64))
    for k, size in zip(at.tolist(), sizes, strict=True):
        filled[k] += size
    return filled, used


def test_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([1, 2, 3, 7, 8, 15, 16, 64, 100])
        sizes = sorted((rng.randint(0, rng.choice([3, capacity]) if capacity > 3 else capacity) for _ in range(rng.randint(0, 90))), reverse=True)
        filled, used = containers(sizes, capacity)
        want = naive(sizes, capacity)
        assert sorted(capacity - x for x in filled.values()) == want
        assert used == len(want) or not any(sizes)


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(4)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    plan, used = planned(counts, 2048)
    assert len(plan) < 2048 * 11
    total = sum(s * n for s, n in counts.items())
    assert 0.98 * used * 2048 <= total <= used * 2048


def test_items_above_half_the_capacity(spark):
    """None of them fit together, in buckets far smaller than their number, with a third of one size."""
    df = spark.range(300_000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, 1500).otherwise(1025 + F.col("id") % 1000).alias("size"))
    got = packed(df, "doc", "size", Workspace(spark, "t"), bucket=1000)
    each = got.groupBy("container").agg(F.count("*").alias("n"), F.sum("size").alias("filled"))
    row = each.agg(F.count("*").alias("c"), F.max("n").alias("n"), F.sum("filled").alias("t")).first()
    assert (row["c"], row["n"]) == (300_000, 1) and row["t"] == df.agg(F.sum("size")).first()[0]


def test_buckets_make_no_difference_to_the_fill(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 5, rng.randint(1, 60), rng.randint(50, 100)]) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc bigint, size bigint")
    want = naive(sorted(sizes, reverse=True), 100)
    for bucket in (7, 100_000):
        filled = Counter()
        for r in packed(df, "doc", "size", Workspace(spark, "t"), capacity=100, bucket=bucket).collect():
            filled[r["container"]] += r["size"]
        assert sorted(100 - x for x in filled.values()) == want


@pytest.mark.parametrize("bucket", [10_000, 40])
def test_containers_hold_everything_once(spark, bucket):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.randint(0, 40), rng.randint(41, 350)]), "x", 1) for k in range(500)] + [(900, None, "x", 1), (901, -4, "x", 1), (902, 100, "x", 1), (902, 100, "x", 1), (None, 7, "x", 1)]
    df = spark.createDataFrame(rows, "doc bigint, size bigint, piece string, _row int")
    got = packed(df, "doc", "size", Workspace(spark, "t"), capacity=100, bucket=bucket).collect()
    filled, tokens, pieces = Counter(), Counter(), Counter()
    for r in got:
        filled[r["container"]] += r["size"]
        tokens[r["doc"]] += r["size"]
        pieces[r["doc"], r["piece"]] += 1
        assert r["start"] == r["piece"] * 100 and (r["piece"] == 0 or r["size"] > 0)
    assert max(filled.values()) <= 100
    want = Counter()
    for k, size, _, _ in rows:
        want[k] += max(size or 0, 0)
    assert tokens == want and set(tokens) == {r[0] for r in rows}
    assert pieces[902, 0] == 2 and len(filled) * 100 < 1.02 * sum(want.values()) + 100


def test_only_empty_items(spark):
    df = spark.createDataFrame([(k, 0) for k in range(5)], "doc bigint, size bigint")
    assert {(r["container"], r["size"]) for r in packed(df, "doc", "size", Workspace(spark, "t")).collect()} == {(0, 0)}


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "doc bigint, size bigint")
    assert packed(df, "doc", "size", Workspace(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        packed(df, "doc", "size", Workspace(spark, "t"), capacity=0)


def test_sizes_in_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc bigint, text string")
    assert sorted(map(tuple, token_counts(df, "doc", "text").collect())) == [(1, 2), (2, 0), (3, 0)]
