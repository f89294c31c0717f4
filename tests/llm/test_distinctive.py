import math
import random
from collections import Counter

from pyspark.sql import functions as F

from twinspan.llm.distinctive import term_scores
from twinspan.work import Workspace

SCHEMA = "id bigint, terms array<bigint>, term string, df string"


def brute(records, scale=1.0):
    df = Counter(t for s in records.values() for t in s)
    total = sum(df.values())
    out = {}
    for key, s in records.items():
        for t in s:
            a, a0 = df[t] * scale, total * scale
            inside, outside, n = 1 + a, df[t] - 1 + a, len(s)
            delta = math.log(inside / max(n + a0 - inside, 1e-9)) - math.log(outside / max(total - n + a0 - outside, 1e-9))
            out[key, t] = delta / math.sqrt(1 / inside + 1 / outside)
    return out


def test_scores_equal_brute_force_with_a_hot_term(spark):
    rng = random.Random(1)
    records = {k: sorted({0, *(rng.randint(1, 60) for _ in range(rng.randint(0, 9)))}) for k in range(80)}
    rows = [(k, v, "clash", "clash") for k, v in records.items()] + [(900, [], "", ""), (901, None, "", "")]
    got = term_scores(spark.createDataFrame(rows, SCHEMA), "id", "terms", Workspace(spark, "t")).collect()
    want = brute(records)
    assert len(got) == len(want)
    assert all(abs(r["z"] - want[r["id"], r["term"]]) < 1e-9 for r in got)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert term_scores(empty, "id", "terms", Workspace(spark, "t")).count() == 0
    one = spark.createDataFrame([(1, [7], "x", "y")], SCHEMA)
    assert [r["df"] for r in term_scores(one, "id", "terms", Workspace(spark, "t")).collect()] == [1]


def test_rarer_is_higher_at_any_size():
    """With scale 1 the score falls strictly with the count, so the rarest shared term has the highest score."""
    for n, total in ((5, 100), (30, 10_000), (90, 10**7)):
        last = math.inf
        for df in [*range(1, 60), *range(60, min(total // 3, 10**6), max(total // 300, 1))]:
            inside, outside = 1 + df, 2 * df - 1
            z = (math.log(inside / (n + total - inside)) - math.log(outside / (2 * total - n - outside))) / math.sqrt(1 / inside + 1 / outside)
            assert z < last
            last = z


def test_hot_terms_do_not_change_results(spark):
    import twinspan.operators.skew as skew

    rows = spark.createDataFrame([(k, [1, 2 + k % 3], "", "") for k in range(50)], SCHEMA)
    first = term_scores(rows, "id", "terms", Workspace(spark, "t")).orderBy("id", "term").collect()
    old, skew.HOT = skew.HOT, 3
    try:
        assert term_scores(rows, "id", "terms", Workspace(spark, "t")).orderBy("id", "term").collect() == first
    finally:
        skew.HOT = old
    assert {r["df"] for r in first if r["term"] == 1} == {50} and F is not None
