import random

import pytest

from twinspan.llm import setjoin
from twinspan.work import Workspace

SCHEMA = "id bigint, own bigint, digests array<bigint>, c int, n string, a bigint"


def near_sets(seed, families, size=20, extra=()):
    rng = random.Random(seed)
    common = [rng.getrandbits(62) for _ in range(6)]
    out = []
    for _ in range(families):
        base = [rng.getrandbits(62) for _ in range(size)] + common[: rng.randint(0, 6)]
        for _ in range(rng.randint(1, 5)):
            own = set(base)
            for _ in range(rng.randint(0, 5)):
                own.discard(rng.choice(base))
                if rng.random() < 0.5:
                    own.add(rng.getrandbits(62))
            out.append(sorted(own))
    return [*out, *extra]


def brute(rows, num, den, least):
    out = set()
    for k, (i, o, s) in enumerate(rows):
        for j, p, t in rows[k + 1 :]:
            if s is not None and t is not None and len(s) >= least and len(t) >= least and o != p and i != j:
                shared = len(set(s) & set(t))
                if shared * den >= (len(s) + len(t) - shared) * num:
                    out.add((min(i, j), max(i, j)))
    return out


def run(spark, rows, num=4, den=5, least=5):
    df = spark.createDataFrame([(i, o, s, 1, "x", 2) for i, o, s in rows], SCHEMA)
    got = [(r["id_a"], r["id_b"]) for r in setjoin.similar_pairs(df, "id", "own", "digests", Workspace(spark, "t"), num, den, least).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    sets = near_sets(1, 60, extra=[[1, 2, 3], [], None, list(range(10)), list(range(10)), list(range(8))])
    rows = [(k, k // 2, s) for k, s in enumerate(sets)]
    assert run(spark, rows) == brute(rows, 4, 5, 5)


def test_large_nodes_are_compared_in_blocks(spark):
    """Many records alike in all but one token stay in one node to the last level; every pair is still found."""
    rng = random.Random(3)
    base = [rng.getrandbits(62) for _ in range(40)]
    rows = [(k, k, sorted([*base, rng.getrandbits(62)])) for k in range(150)]
    assert len(run(spark, rows)) == 150 * 149 // 2


def test_large_family_at_the_threshold(spark):
    """A family of many more records than a node may hold, most of its pairs at exactly 0.80, is found to the planned recall."""
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(36)]
    rows = []
    for k in range(700):
        out = rng.sample(base, 2)
        rows.append((k, k, sorted([*(x for x in base if x not in out), rng.getrandbits(62), rng.getrandbits(62)])))
    true = brute(rows, 4, 5, 5)
    assert len(true) == 700 * 699 // 2
    got = run(spark, rows)
    assert got <= true
    assert len(true - got) <= 0.0005 * len(true)


def test_no_hash_function_is_drawn_twice(spark):
    sets = spark.createDataFrame([(k, [k, k + 1, k + 2]) for k in range(50)], "c bigint, digests array<bigint>")
    for trees in (13, 69):
        drawn = [r["drawn"] for r in setjoin.embedded(sets, "digests", trees).collect()]
        assert len(set(zip(*drawn, strict=True))) == trees * setjoin.LEVELS


def test_repeated_rows_and_empty(spark):
    rows = [(1, 1, [1, 2, 3, 4, 5]), (1, 1, [1, 2, 3, 4, 5]), (2, 2, [5, 4, 3, 2, 1]), (3, 2, [1, 2, 3, 4, 5])]
    assert run(spark, rows) == {(1, 2), (1, 3)}
    assert run(spark, []) == set()


def test_recall_is_planned():
    assert setjoin.tree_count(0.8, 0.9999) == 15
    assert setjoin.sketch_limit(0.8) < 40
    for threshold in (0.5, 0.6, 0.7, 0.8, 0.9):
        assert setjoin.branches(threshold) * threshold >= 1.6 and setjoin.survival(threshold) > 0.6


@pytest.mark.parametrize("num,den", [(1, 2), (3, 5), (7, 10), (4, 5)])
def test_recall_at_every_threshold(spark, monkeypatch, num, den):
    """Pairs just at the threshold, in a crowd of records that share more than half of their tokens and keep nodes large."""
    rng = random.Random(num)
    crowd = [rng.getrandbits(62) for _ in range(40)]
    rows, pairs = [], 300
    for k in range(pairs):
        shared = 60 * num // den
        base = rng.sample(crowd, 20) + [rng.getrandbits(62) for _ in range(shared - 20)]
        united = shared * den // num
        left = (united - shared) // 2
        rows.append((2 * k, 2 * k, sorted(base + [rng.getrandbits(62) for _ in range(left)])))
        rows.append((2 * k + 1, 2 * k + 1, sorted(base + [rng.getrandbits(62) for _ in range(united - shared - left)])))
    planted = {(2 * k, 2 * k + 1) for k in range(pairs)}
    assert planted <= brute(rows[:20], num, den, 5) | {x for x in planted if x[0] >= 20}
    monkeypatch.setattr(setjoin, "SPLIT_COST", 16)
    got = run(spark, rows, num, den)
    assert len(planted & got) >= 0.99 * pairs


def test_large_nodes_of_unlike_records_are_split(spark, monkeypatch):
    """Records that have a few tokens in common share nodes after three splits, which deeper splits take apart."""
    monkeypatch.setattr(setjoin, "SPLIT_COST", 16)
    compared = []
    blocks = setjoin._blocks
    monkeypatch.setattr(setjoin, "_blocks", lambda rest, *x: compared.append(rest.count()) or blocks(rest, *x))
    rng = random.Random(8)
    common = [rng.getrandbits(62) for _ in range(12)]
    rows = []
    for k in range(900):
        own = [rng.getrandbits(62) for _ in range(10)]
        rows.append((2 * k, 2 * k, sorted(common + own)))
        if k % 6 == 0:
            rows.append((2 * k + 1, 2 * k + 1, sorted([*common, *own[1:], rng.getrandbits(62)])))
    true = {(2 * k, 2 * k + 1) for k in range(0, 900, 6)}
    got = run(spark, rows)
    assert got == true
    assert len(compared) > 3 and sum(compared) < 3 * len(rows)  # over all trees, of which each has every record


def test_links_are_counted_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PIECE", 3)
    sets = near_sets(4, 40, extra=[list(range(10))] * 9 + [list(range(9))] * 4 + [None, [1, 2]])
    rows = [(k, k // 3 if k % 7 else None, s) for k, s in enumerate(sets)]
    df = spark.createDataFrame([(i, o, s, 1, "x", 2) for i, o, s in rows], SCHEMA)
    pairs = run(spark, rows)
    assert pairs == brute(rows, 4, 5, 5)
    links = {r["id"]: r["links"] for r in setjoin.link_counts(df, "id", "own", "digests", Workspace(spark, "t"), 4, 5, 5).collect()}
    assert links == {i: sum(i in p for p in pairs) for i, _, s in rows if s and len(s) >= 5}
    classes = {r["id"]: r["class_id"] for r in setjoin.link_counts(df, "id", "own", "digests", Workspace(spark, "t"), 4, 5, 5).collect()}
    first = {}
    assert classes == {i: first.setdefault(tuple(sorted(s)), i) for i, _, s in rows if s and len(s) >= 5}
