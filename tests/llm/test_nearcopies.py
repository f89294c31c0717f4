from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_components import brute as joined
from tests.llm.test_setjoin import brute, near_sets
from twinspan.llm import nearcopies
from twinspan.work import Workspace


def run(spark, sets, num=7, den=10, least=5, links=None):
    rows = [(k, s, 1, "x") for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key bigint, digests array<bigint>, c int, id string")
    link = spark.createDataFrame(links, "a bigint, b bigint") if links else None
    got = nearcopies.near_copies(df, "key", "digests", Workspace(spark, "t"), num, den, least, link).collect()
    return {r["id"]: r["group_id"] for r in got}


def expected(sets, num=7, den=10, least=5, links=()):
    rows = [(k, k, s) for k, s in enumerate(sets)]
    return joined([*brute(rows, num, den, least), *links])


def test_equals_brute_force(spark):
    sets = near_sets(5, 40, extra=[None, [], [1, 2], list(range(7)), list(range(7)), list(range(5)), list(range(100, 107)), list(range(101, 108))])
    assert run(spark, sets) == expected(sets)
    assert run(spark, sets, links=[(0, 40), (41, 41), (None, 1)]) == expected(sets, links=[(0, 40)])


def test_large_sets_use_finer_lines(spark):
    sets = near_sets(6, 8, size=200)
    assert run(spark, sets) == expected(sets)


def test_sets_in_one_partition_are_met_by_their_tokens(spark):
    """All tokens on one bit: the budget exceeds what the filled partition can take, so tokens are looked up."""
    line = nearcopies.Line(np.zeros(0, np.uint64), np.arange(nearcopies.BITS))
    tokens = np.arange(1, 200_000, dtype=np.uint64)
    crowded = tokens[line.parts(tokens, np.int64(nearcopies.PARTS)) == 3][:14].astype(np.int64).tolist()
    sets = [crowded[:12], crowded[1:13], crowded[2:14], list(range(50, 62))]
    assert run(spark, sets) == expected(sets)


@pytest.mark.parametrize("size,copies", [(5_000, 12), (50_000, 4)])
def test_very_large_sets(spark, size, copies):
    """Thousands of partitions, planned in blocks, with pairs just at and below the threshold."""
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**62, size)
    sets = []
    for k in range(copies):
        lost = [0, size * 3 // 17, size * 3 // 17 + 1, size // 10, size // 3, size // 20][k % 6] // (1 + k // 6)
        sets.append(np.concatenate([base[rng.permutation(size)[lost:]], rng.integers(0, 2**62, lost)]).tolist())
    sets.append(base[: size * 7 // 10].tolist())
    sets.append(base[: size * 7 // 10 - 1].tolist())
    assert run(spark, sets) == expected(sets)


def test_levels_have_no_end():
    n = np.array([5, 1_000, 10**6, 10**8])
    level = nearcopies.levels_of(n, 7, 10)
    assert (nearcopies.PARTS * 2.0**level >= nearcopies.difference(n, 7, 10) + 1).all()


def test_plan_in_blocks(monkeypatch):
    """Blocks take all of the need, no more than they can, and cost little more than the plan of the whole line."""
    rng = np.random.default_rng(3)
    cost0 = rng.integers(0, 50, (20, 24))
    cost0[rng.random(cost0.shape) < 0.2] = nearcopies.FAR
    cost1 = np.where((cost0 < nearcopies.FAR) & (rng.random(cost0.shape) < 0.8), cost0 + rng.integers(0, 60, cost0.shape), nearcopies.FAR)
    most = (cost0 < nearcopies.FAR).sum(axis=1) + (cost1 < nearcopies.FAR).sum(axis=1)
    need = np.array([rng.integers(1, m + 1) for m in most])
    need[0] = most[0] + 1
    whole, able = nearcopies.thresholds(cost0, cost1, need)
    monkeypatch.setattr(nearcopies, "BLOCK", 6)
    cut, same = nearcopies.thresholds(cost0, cost1, need)
    assert able.tolist() == same.tolist() == [False] + [True] * 19
    price = lambda t: np.where(t == 1, cost1, np.where(t == 0, cost0, 0)).sum(axis=1)[able]
    for t in (whole, cut):
        assert ((t + 1).sum(axis=1) >= need)[able].all() and (price(t) < nearcopies.FAR).all()
    assert (price(whole) <= price(cut)).all() and price(cut).sum() <= 1.1 * price(whole).sum()


def test_hot_keys_are_met_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PIECE", 3)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 30).tolist()
    sets = [[*base, int(x)] for x in rng.integers(0, 2**62, 60)] + [[*base[:24], k, k + 1] for k in range(5)]
    assert run(spark, sets) == expected(sets)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [None, [1]]) == {}


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    cost0 = rng.integers(0, 50, (40, 5))
    cost1 = cost0 + rng.integers(0, 50, (40, 5))
    need = rng.integers(0, 11, 40)
    got = nearcopies.allocated(cost0, cost1, need)
    for r in range(40):
        price = lambda t: sum((0, cost0[r, i], cost1[r, i])[x + 1] for i, x in enumerate(t))
        best = min(price(t) for t in product((-1, 0, 1), repeat=5) if sum(x + 1 for x in t) >= need[r])
        assert sum(x + 1 for x in got[r]) >= need[r] and price(got[r]) == best


def test_scores(spark):
    rows = [("7/10", None, None), ("0.7", None, None), ("70%", None, None), ("0.69999", 9, 10), (None, 7, 10), (None, 69, 100), (None, 7, None), ("", 8, 10), ("x", 1, 1), ("1/0", 1, 1), ("69.99%", 1, 1), (" 1.0 ", None, None), ("/", 1, 1)]
    df = spark.createDataFrame(rows, "s string, x bigint, y bigint")
    got = [r[0] for r in df.select(nearcopies.score_reaches(F.col("s"), F.col("x"), F.col("y"), 7, 10)).collect()]
    assert got == [True, True, True, False, True, False, False, True, False, False, False, True, False]
    assert Fraction(7, 10) == Fraction("0.7")
