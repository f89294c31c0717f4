import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinspan.operators import clusters, contract, findings, fingerprints, fragments, identical, similarity, skew
from twinspan.sources import frontends
from twinspan.work import Workspace

UNIT = "entry_id bigint, root_digest string, path string, start_line int, end_line int, node_count int, threshold bigint, min_lines int, min_nodes int"


def unit(k, digest="d", lines=10, nodes=30, floors=(4, 20), path=None, start=1):
    return (k, digest, path or f"f{k}.rb", start, start + lines - 1, nodes, 800_000, *floors)


def joined(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_bare_entries(spark):
    sets = spark.createDataFrame([(1, [1, 2]), (2, [1, 3]), (3, [1, 4]), (4, []), (5, None)], "id bigint, digests array<bigint>")
    got = {r["digest"]: (r["df"], r["w"]) for r in fingerprints.digest_counts(sets).collect()}
    assert got[1][0] == 3 and got[2][0] == 1 and got[1][1] < got[2][1]


def test_prefix_join_equals_all_pairs(spark):
    rng = random.Random(42)
    sets = {}
    for family in range(8):
        base = rng.sample(range(family * 13, family * 13 + 13), 7)
        for v in range(5):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(7)] = rng.randrange(200)
            sets[family * 5 + v] = sorted(set(own))
    df = spark.createDataFrame(list(sets.items()), "id bigint, digests array<bigint>")
    for num, den in ((4, 5), (1, 2)):
        work = Workspace(spark, "t")
        rows = similarity.weighted_sets(df, "id", work)
        weights = {r["digest"]: r["w"] for r in rows.collect()}
        total = lambda s: sum(weights[x] for x in s)
        want = set()
        for a in sets:
            for b in sets:
                shared = total(set(sets[a]) & set(sets[b]))
                union = total(set(sets[a]) | set(sets[b]))
                if a < b and shared * den >= union * num:
                    want.add((a, b, shared, union))
        assert {tuple(r) for r in similarity.similar_units(rows, "id", num, den, work).collect()} == want and want


def test_threshold_is_met_exactly_and_not_above(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 6])], "id bigint, digests array<bigint>")
    work = Workspace(spark, "t")
    rows = similarity.weighted_sets(df, "id", work)
    one = similarity.similar_units(rows, "id", 1, 2, work).first()
    assert similarity.similar_units(rows, "id", one["shared_w"], one["union_w"], work).count() == 1
    assert similarity.similar_units(rows, "id", one["shared_w"] * 1000 + 1, one["union_w"] * 1000, work).count() == 0


def test_eight_hundred_copies_stay_linear(spark):
    units = spark.createDataFrame([unit(k) for k in range(800)], UNIT)
    edges = [(r["a"], r["b"]) for r in identical.identical_stars(units).collect()]
    assert len(edges) < 1600 and set(joined(edges).values()) == {0} and len(joined(edges)) == 800


def test_floors_are_two_dimensional(spark):
    rows = [unit(1, lines=4, nodes=44, floors=(4, 100)), unit(2, lines=5, nodes=44, floors=(10, 20)), unit(3, lines=15, nodes=44, floors=(15, 20))]
    got = {(r["a"], r["b"]) for r in identical.identical_stars(spark.createDataFrame(rows, UNIT)).collect()}
    assert got == {(1, 2), (1, 3)}


def test_stars_avoid_overlaps_and_null_digests(spark):
    rows = [unit(1, path="a", start=1), unit(2, path="a", start=5), unit(3, path="b"), unit(4, digest=None), unit(5, digest=None)]
    got = {(r["a"], r["b"]) for r in identical.identical_stars(spark.createDataFrame(rows, UNIT)).collect()}
    assert got == {(1, 3), (2, 3)}


def test_stars_go_both_ways_between_settings(spark):
    """Every pair across is allowed and none within: all units of both classes are connected."""
    rows = [unit(k, lines=5, floors=(2, 50)) for k in (1, 2, 3)] + [unit(k, lines=5, floors=(10, 20)) for k in (4, 5, 6)]
    edges = [(r["a"], r["b"]) for r in identical.identical_stars(spark.createDataFrame(rows, UNIT)).collect()]
    assert joined(edges) == dict.fromkeys(range(1, 7), 1)
    assert all(a <= 3 < b for a, b in edges)


def test_representatives(spark):
    rows = [unit(3), unit(1), unit(2, lines=11), unit(7, digest=None), unit(8, digest=None), unit(5, floors=(5, 20))]
    got = {tuple(r) for r in identical.representatives(spark.createDataFrame(rows, UNIT)).collect()}
    assert got == {(1, 1), (3, 1), (2, 2), (7, 7), (8, 8), (5, 5)}


def test_lookups_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "EASY", 10)
    monkeypatch.setattr(skew, "HOT", 4)
    rows = [(1 if k % 3 else k, k) for k in range(100)] + [(None, 5), (None, 6)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    stats = spark.createDataFrame([(k, -k) for k in range(60)], "k bigint, w bigint")
    want = {(k, v, -k) for k, v in rows if k is not None and k < 60}
    assert {tuple(r) for r in skew.lookup(df, stats, "k").collect()} == want
    left = {tuple(r) for r in skew.lookup(df, stats, ["k"], "left").collect()}
    assert left == want | {(k, v, None) for k, v in rows if k is None or k >= 60}
    plan = skew.lookup(df, stats, "k")._jdf.queryExecution().toString()
    assert "Union" in plan


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(f"{k * 7919 % 1000:04d}",) for k in range(1000)], "x string").repartition(5)
    got = sorted((r["x"], r["n"]) for r in skew.in_order(df, "x", "n", Workspace(spark, "t")).collect())
    assert got == [(f"{k:04d}", k) for k in range(1000)]


def test_stand_ins(spark):
    reps = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "entry_id bigint, rep_id bigint")
    star = spark.createDataFrame([("d", 1, 3)], "root_digest string, a bigint, b bigint")
    pairs = spark.createDataFrame([(1, 9, 5)], "a bigint, b bigint, s int")
    assert {tuple(r) for r in identical.stood_in(pairs, reps, star).collect()} == {(1, 9, 5), (2, 9, 5)}


def test_fragment_caps(spark):
    def places(n):
        return spark.createDataFrame([(k, "s", f"f{k}", 1, 5) for k in range(n)] + [(900, "t", "x", 1, 5), (901, "t", "x", 3, 9), (902, None, "y", 1, 2)], "loc_id bigint, signature string, path string, start_line int, end_line int")

    assert fragments.fragment_pairs(places(100)).count() == 100 * 99 // 2
    star = fragments.fragment_pairs(places(101)).collect()
    assert len(star) == 100 and {r["a"] for r in star} == {0}
    clashing = places(129).unionByName(spark.createDataFrame([(777, "s", "f0", 4, 8)], places(1).schema))
    assert len(joined((r["a"], r["b"]) for r in fragments.fragment_pairs(clashing).collect())) == 130


def test_large_groups_keep_the_components_of_all_pairs(spark):
    """Groups of over 100 with a floor of 10 lines for some, hubs of 4 lines, and places that share lines with the hubs."""
    rng = random.Random(9)
    rows = []
    for signature in range(6):
        for k in range(40):
            lines, floors, path, start = rng.choice([4, 6, 9, 12, 15]), rng.choice([(4, 20), (10, 20), (5, 40)]), f"f{rng.randint(0, 3 * signature)}", rng.randint(1, 40)
            if k == 0:
                lines, floors = 4, (10, 20)
            rows.append((100 * signature + k, f"s{signature}", path, start, start + lines - 1, 30, *floors))
    # the copy that overlaps the first and the second hub of the file, and one elsewhere
    rows += [(900, "t", "f", 1, 5, 30, 4, 20), (901, "t", "f", 5, 9, 30, 4, 20), (902, "t", "f", 9, 13, 30, 4, 20), (903, "t", "g", 1, 5, 30, 4, 20)]
    df = spark.createDataFrame(rows, "loc_id bigint, signature string, path string, start_line int, end_line int, size int, min_lines int, min_nodes int")

    def allowed(x, y):
        apart = x[2] != y[2] or x[3] > y[4] or y[3] > x[4]
        lines, nodes = min(x[6], y[6]), min(x[7], y[7])
        return x[1] == y[1] and apart and min(x[4] - x[3], y[4] - y[3]) + 1 >= lines and min(x[5], y[5]) >= nodes

    true = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and allowed(x, y)}
    got = [(r["a"], r["b"]) for r in fragments.fragment_pairs(df, cap=3).collect()]
    assert len(got) == len(set(got)) and set(got) <= true and len(got) < 9 * len(rows)
    assert joined(got) == joined(true)
    spoke = spark.createDataFrame([(k, "s", f"f{k}", 1, 4 if k == 0 else 12, 30, 10, 20) for k in range(101)], df.schema)
    assert len(joined((r["a"], r["b"]) for r in fragments.fragment_pairs(spoke).collect() if r["a"] > 0)) == 100


def test_seed_caps(spark):
    rows = lambda n: spark.createDataFrame([(k, ["a", "b", "c"]) for k in range(n)] + [(900, ["a", "b", "c", "z"]), (901, []), (902, ["a"])], "seq_id bigint, digests array<string>")
    assert fragments.run_seeds(rows(49)).count() == 50 * 49 // 2
    star = fragments.run_seeds(rows(50)).collect()
    assert len(star) == 50 and all(r["a"] == 0 for r in star)


def test_seed_hub_spans_most_lines(spark):
    """The longest sequence, all on one line, is no hub for 50 that span three lines."""
    rows = [(0, list("abcz"), [1, 1, 1, 1], [1, 1, 1, 1])] + [(k, list("abc"), [1, 2, 3], [1, 2, 3 + (k == 7)]) for k in range(1, 51)]
    star = fragments.run_seeds(spark.createDataFrame(rows, "seq_id bigint, digests array<string>, starts array<int>, ends array<int>")).collect()
    assert len(star) == 50 and all(7 in (r["a"], r["b"]) for r in star)


def extended(x, y, first, last, d):
    """Grow forward, then, with nothing gained, backward, over one differing statement."""
    same = lambda i: 0 <= i < len(x) and 0 <= i - d < len(y) and x[i] == y[i - d]
    if same(last + 2):
        last += 2
        while same(last + 1):
            last += 1
    elif same(first - 2):
        first -= 2
        while same(first - 1):
            first -= 1
    return first, last


def test_runs_equal_greedy_growth(spark):
    rng = random.Random(7)
    seqs = {k: [rng.choice("abc") for _ in range(rng.randint(3, 11))] for k in range(40)}
    df = spark.createDataFrame(list(seqs.items()), "seq_id bigint, digests array<string>")
    got = {tuple(r) for r in fragments.extended_runs(fragments.run_seeds(df, cap=10**6), df).collect()}
    want = set()
    for a in seqs:
        for b in range(a, len(seqs)):
            x, y = seqs[a], seqs[b]
            for d in range(-len(y) + 1, len(x)):
                if a == b and d >= 0:
                    continue
                i = 0
                while i < len(x):
                    j = i
                    while j < len(x) and 0 <= j - d < len(y) and x[j] == y[j - d]:
                        j += 1
                    if j - i >= 3:
                        first, last = extended(x, y, i, j - 1, d)
                        if a != b or abs(d) > last - first:
                            want.add((a, b, d, i, j - 1, first, last))
                    i = max(j, i + 1)
    assert got == want


def test_prune_drops_what_lies_inside(spark):
    schema = "match_id int, ea bigint, sa int, ta int, eb bigint, sb int, tb int, whole boolean, size int, ka string, kb string"
    rows = [(1, 1, 1, 20, 2, 1, 20, True, 50, "a", "b"), (2, 1, 3, 6, 2, 3, 6, False, 10, "a1", "b1"), (3, 2, 4, 5, 1, 4, 5, False, 5, "b2", "a2"), (4, 1, 3, 30, 2, 3, 6, False, 60, "a3", "b3"), (5, 3, 1, 5, 3, 11, 15, False, 9, "c", "d"), (6, 3, 12, 14, 3, 2, 4, False, 5, "e", "f")]
    got = {r["match_id"] for r in fragments.pruned(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1, 4, 5}
    twins = spark.createDataFrame([(1, "g"), (2, "g")], "entry_id bigint, group string")
    assert {r["match_id"] for r in fragments.without_twins(spark.createDataFrame(rows, schema), twins).collect()} == {1, 5, 6}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(180)] + [(k, k + 1) for k in range(500, 560)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in clusters.components(df, "a", "b", Workspace(spark, "t")).collect()}
    assert got == joined([e for e in edges if e[0] != e[1]])
    assert clusters.components(df.limit(0), "a", "b", Workspace(spark, "t")).count() == 0
    members = spark.createDataFrame([(7, "b"), (7, "c"), (3, "a"), (9, "d")], "component bigint, key string")
    assert {tuple(r) for r in clusters.numbered(members, "component", "key", Workspace(spark, "t")).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


LOCATION = "loc_id bigint, component bigint, path string, start_line int, end_line int, size int, whole boolean, kind string, namespace string, identity string, language string, key string, structural string"


def location(k, component=1, path=None, start=1, end=9, key=None, structural=None, whole=True, namespace="A", size=10):
    return (k, component, path or f"app/models/{k}.rb", start, end, size, whole, "method", namespace, f"A#m{k}", "ruby", key or f"k{k}", structural or f"s{k}")


def test_touched_age_and_ends(spark):
    df = spark.createDataFrame([location(1), location(2, start=10, end=20), location(3)], LOCATION)
    changed = spark.createDataFrame([("app/models/1.rb", 9, 30), ("app/models/2.rb", 1, 9), ("app/models/2.rb", 21, 99)], "path string, from_line int, to_line int")
    blame = spark.createDataFrame([("app/models/2.rb", 15, 500), ("app/models/2.rb", 9, 900), ("app/models/1.rb", 2, 100)], "path string, line int, ts bigint")
    told = findings.aged(findings.touched(df, changed), blame)
    assert {r["loc_id"]: (r["touched"], r["age"]) for r in told.collect()} == {1: (True, float("inf")), 2: (False, 500.0), 3: (False, 0.0)}
    assert tuple(findings.originals(told).first()) == (1, 3, 1)


def test_payoff_scores_the_copy_with_the_original(spark):
    df = spark.createDataFrame([location(1), location(2, size=20), location(3, size=40)], LOCATION)
    edges = spark.createDataFrame([(1, 3, 0.9), (2, 3, 0.8), (1, 2, 0.5)], "a bigint, b bigint, score double")
    ends = spark.createDataFrame([(1, 1, 3)], "component bigint, original bigint, copy bigint")
    assert findings.payoffs(df, findings.end_scores(df, edges, ends)).first()["payoff"] == round(40 * 0.9 + 20 * 0.8, 1)


def test_labels(spark):
    def label(rows, touched, by_key=(), by_structure=()):
        df = spark.createDataFrame(rows, LOCATION).withColumn("touched", F.col("loc_id").isin(*touched) if touched else F.lit(False))
        keys = spark.createDataFrame(list(by_key), "key string, cluster bigint")
        shapes = spark.createDataFrame(list(by_structure), "structural string, cluster bigint")
        return findings.labels(df, keys, shapes).first()["label"]

    two = [location(1), location(2)]
    assert label(two, [1]) == "introduced"
    assert label(two, [1], [("k1", 5), ("k2", 5)]) == "already_there"
    assert label(two, [1], [("k1", 5), ("k2", 6)]) == "introduced"
    assert label(two, [], [("k1", 5), ("k2", 6)]) == "shifted"
    assert label(two, [], [("k1", 5)], [("s2", 5), ("s2", 7)]) == "already_there"
    assert label([*two, location(3)], [3], [("k1", 5), ("k2", 5)]) == "introduced"


def test_contracted_counts_occurrences(spark):
    schema = "ka string, kb string, sa string, sb string, score double"
    base = spark.createDataFrame([("a", "b", "s", "t", 1.0), ("a", "c", "s", "t", 1.0), ("b", "c", "s", "t", 1.0), ("x", "y", "u", "v", 0.9)], schema)
    head = spark.createDataFrame([("a", "b", "s", "t", 1.0), ("x2", "y2", "u", "v", 0.9)], schema)
    assert {tuple(r)[:2] for r in findings.contracted(base, head).collect()} == {("a", "c"), ("b", "c")}


def test_exit_codes_notes_and_narrowing(spark):
    assert findings.exit_code(0, 0, 0, 0) == 0 and findings.exit_code(1, 1, 0, 0) == 1 and findings.exit_code(1, 0, 0, 0, introduced_only=True) == 0
    assert findings.exit_code(0, 0, 1, 0) == 1 and findings.exit_code(1, 1, 1, 1, True) == 2 and findings.exit_code(1, 1, 1, 0, True) == 0
    assert findings.notes(True, False, [], False) == [] and len(findings.notes(False, True, ["a"], True)) == 4
    df = spark.createDataFrame([location(1), location(2, component=2, path="lib/a.rb"), location(3, component=3, path="lib2/a.rb")], LOCATION)
    assert {r[0] for r in findings.narrowed(df, ["lib"]).collect()} == {2} and findings.narrowed(df, ["."]).count() == 3


def test_contract_operators(spark):
    units = spark.createDataFrame([(1, "A::B#x", "A::B", "method"), (2, "A::C#y", "A::C", "method"), (3, "D#z", "D", "method"), (4, "views/a/show", None, "template")], "entry_id bigint, identity string, namespace string, kind string")
    refs = spark.createDataFrame([(1, "A"), (2, "A::*"), (3, "A::B#x"), (4, "views/**"), (5, "Nope"), (6, "**::C"), (7, None)], "ref_id bigint, text string")
    hits = contract.reference_hits(refs, units)
    by = defaultdict(set)
    for r in hits.collect():
        by[r["ref_id"]].add(r["entry_id"])
    assert by == {1: {1, 2}, 2: {1, 2}, 3: {1}, 4: {4}, 6: {2}}
    assert {r["ref_id"] for r in contract.unknown_references(refs, hits).collect()} == {5, 7}
    own = contract.assigned(hits, refs.withColumn("clause_id", F.lit(1)))
    assert {(r["entry_id"], r["text"]) for r in own.collect()} == {(1, "A::B#x"), (2, "A::*"), (4, "views/**")} or {(r["entry_id"], r["text"]) for r in own.collect()} == {(1, "A::B#x"), (2, "A"), (4, "views/**")}
    matches = spark.createDataFrame([(10, 1, 2), (11, 1, 1), (12, 2, 3)], "match_id bigint, ea bigint, eb bigint")
    clauses = spark.createDataFrame([(1, "p", 1), (2, "a", 1)], "clause_id int, path string, line int")
    kept = contract.kept(matches, own, clauses)
    assert [tuple(r) for r in kept.collect()] == [(10, 1)]
    assert [r["clause_id"] for r in contract.stale(clauses, kept).collect()] == [2]
    covers = refs.withColumn("primitive", F.when(F.col("ref_id") == 3, "narrow").otherwise("wide"))
    assert {tuple(r) for r in contract.primitive_of(hits, covers).collect()} == {(1, "narrow"), (2, "wide"), (4, "wide")}
    settings = spark.createDataFrame([("r", 600000, None, 50)], "repo string, threshold bigint, min_lines int, min_nodes int")
    assert tuple(contract.floors(settings).first()) == (600000, 4, 20)
    got = contract.unit_settings(units.withColumn("repo", F.when(F.col("entry_id") == 1, "r")), settings, "repo")
    assert {tuple(r)[-3:] for r in got.collect()} == {(600000, 4, 50), (800000, 4, 20)}


def test_kept_matches_hide_no_twins(spark):
    """Pairs joined through hubs are exactly those that no clause keeps."""
    names = {1: "A", 2: "A", 3: "B", 4: None, 5: "B", 6: None, 7: "C"}
    members = spark.createDataFrame([("g", k) for k in names] + [("other", 9)], "group string, entry_id bigint")
    assignment = spark.createDataFrame([(1, k, t) for k, t in names.items() if t], "clause_id int, entry_id bigint, text string")
    kept = spark.createDataFrame([("g", "g"), ("g", "g")], "ga string, gb string")
    edges = {(r["ea"], r["eb"]) for r in contract.unkept_twins(kept, members, assignment).collect()}
    keeps = lambda a, b: names[a] and names[b] and names[a] != names[b]
    assert edges and not any(keeps(a, b) for a, b in edges) and all(a < b for a, b in edges)
    assert set(joined(edges).values()) == {1} and len(joined(edges)) == 7
    alone = spark.createDataFrame([("g", k) for k in (1, 3, 7)], "group string, entry_id bigint")
    assert contract.unkept_twins(kept, alone, assignment).count() == 0


def test_trees(spark):
    texts = spark.createDataFrame([(1, "<div data-action='go'><p>a</p><br></div>", "html"), (2, '{"a": [1, 2]}', "json"), (3, "def f(x):\n    return g(x) + 1\n", "python"), (4, "def f(", "python"), (5, None, "json"), (6, "x", None)], "id bigint, c string, l string")
    nodes = frontends.tree_nodes(texts, "id", "c", "l")
    again = fingerprints.digested(nodes.drop("digest", "size", "child_digests"))
    assert sorted(map(str, again.select(*nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    rows = defaultdict(list)
    for r in nodes.collect():
        rows[r["entry_id"]].append(r)
    assert set(rows) == {1, 2, 3}
    for own in rows.values():
        own.sort(key=lambda r: r["preorder"])
        assert [r["preorder"] for r in own] == list(range(len(own)))
        assert all(r["size"] == r["subtree_end"] - r["preorder"] + 1 for r in own)
    assert any(r["kind"] == "literal" and r["label"] == "go" for r in rows[1])
    names = frontends.python_tree("def f(x):\n    return g(x) + 1\n")
    same = frontends.python_tree("def other(y):\n    return g(y) + 2\n")
    assert frontends.flattened(names) == frontends.flattened(same)
    digests = spark.createDataFrame([("s", ["a" * 16, "b" * 16, "c" * 16, "d" * 16])], "k string, d array<string>")
    assert fingerprints.child_trigrams(digests, "k", "d").count() == 2
    import hashlib

    want = hashlib.sha256(bytes.fromhex("a" * 16 + "b" * 16)).hexdigest()[:16]
    assert digests.select(fingerprints.run_digest(F.slice("d", 1, 2))).first()[0] == want


def test_text_fingerprints_are_tree_digests(spark):
    got = frontends.text_fingerprints(spark.createDataFrame([(1, "b a\n\n  a\r\n"), (2, ""), (3, None)], "id int, t string"), "id", "t").collect()
    word = lambda w: fingerprints.node_digest("word", w, [])
    lines = [fingerprints.node_digest("line", "", [word("b"), word("a")]), fingerprints.node_digest("line", "", [word("a")])]
    whole = fingerprints.node_digest("text", "", lines)
    assert {r["id"] for r in got} == {1, 2}
    assert set(got[0]["digests"]) == {x.hex() for x in (word("a"), word("b"), *lines, whole)} and got[0]["lines"] == [x.hex() for x in lines]


def test_json_nodes_have_lines():
    text = '{\n "a": [1, "x:y",\n  {"b": null}],\n "c": {\n }\n}\n'
    tree = frontends.json_tree(text)
    assert tree[:4] == ("object", None, 1, 6)
    a, c = tree[4]
    assert a[:4] == ("member", "a", 2, 3) and c[:4] == ("member", "c", 4, 5)
    assert [x[:4] for x in a[4][0][4]] == [("literal", None, 2, 2), ("literal", None, 2, 2), ("object", None, 3, 3)]
    assert c[4][0][:4] == ("object", None, 4, 5) and frontends.json_tree(" 1 ")[:4] == ("literal", None, 1, 1)
    for bad in ("", "{", "[1,]"):
        with pytest.raises(ValueError):
            frontends.json_tree(bad)
