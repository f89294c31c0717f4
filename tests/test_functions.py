import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from twinspan.functions import paths, references
from twinspan.functions.digests import digest_number, digest_text, effective_sets
from twinspan.functions.weights import exact_threshold, reaches, weight
from twinspan.operators.fingerprints import node_digest


def test_pinned_weights(spark):
    rows = [(1, 6908755), (2, 6216606), (1000, 693147), (10000, 95310), (None, 6908755)]
    df = spark.createDataFrame(rows, "df bigint, w bigint")
    assert df.where(weight("df") != F.col("w")).count() == 0


def test_weights_equal_a_long_decimal_log(spark):
    getcontext().prec = 40
    counts = [1, 2, 3, 7, 50, 999, 1000, 123456]
    got = {r["df"]: r["w"] for r in spark.createDataFrame([(c,) for c in counts], "df bigint").select("df", weight("df").alias("w")).collect()}
    assert got == {c: int(((1 + Decimal(1000) / c).ln() * 10**6).to_integral_value("ROUND_HALF_UP")) for c in counts}


def test_pinned_digest():
    leaf = node_digest(":local", None, [])
    assert int.from_bytes(node_digest("call_node", "map", [leaf]), "big") == 4089009902997379658
    assert node_digest("a", "", []) == node_digest("a", None, [])


def test_digest_spellings(spark):
    same = ["00ab", "AB", "0xab", " 0X00000000000000ab\t", "0xab", "00000000000000AB"]
    rows = [(1, [*same, None, "", "  ", "zz", "1" * 17, "0x", "ffffffffffffffff", "0"]), (2, []), (3, None), (4, [None]), (5, ["0x" + "1" * 14])]
    got = {r["id"]: r["digests"] for r in effective_sets(spark.createDataFrame(rows, "id int, s array<string>"), "s").collect()}
    as_number = lambda x: x - 2**63
    assert got[1] == [as_number(0), as_number(0xAB), as_number(2**64 - 1)]
    assert got[2] == [] and got[3] is None and got[4] == [] and got[5] == [as_number(int("1" * 14, 16))]
    df = spark.createDataFrame([(x,) for x in [*same, "ffffffffffffffff", "xyz", None]], "s string")
    assert [r[0] for r in df.select(digest_text(digest_number("s"))).collect()] == ["00000000000000ab"] * 6 + ["f" * 16, None, None]


def test_thresholds_meet_equality(spark):
    row = spark.range(1).select(reaches(F.lit(4), F.lit(5), 4, 5), reaches(F.lit(799), F.lit(1000), 4, 5), reaches(F.lit(0), F.lit(0), 0, 1), reaches(F.lit(7 * 10**17), F.lit(9 * 10**17), 700000, 900000)).first()
    assert list(row) == [True, False, False, True]
    df = spark.createDataFrame([(x,) for x in [".85", "0.80", " 1 ", "0", "1.1", "x", None]], "t string")
    assert [r[0] for r in df.select(exact_threshold(F.col("t"))).collect()] == [850000, 800000, 1000000, None, None, None, None]


def test_paths(spark):
    rows = {
        "app/models/a.rb": ("ruby", True, False), "app/views/a.html.erb": ("erb", True, False), "app/views/a.html+phone.erb": ("erb", True, False), "a.turbo_stream.erb": ("erb", True, False), "a.text.erb": (None, True, False),
        "vendor/a.rb": ("ruby", False, False), "lib/vendor/a.rb": ("ruby", True, False), ".hidden/a.rb": ("ruby", False, False), "db/schema.rb": ("ruby", False, False), "engines/x/db/a.rb": ("ruby", False, False),
        "lib/db/a.rb": ("ruby", True, False), "spec/a.rb": ("ruby", True, True), "lib/a_test.rb": ("ruby", True, True), "lib/test/a.rb": ("ruby", True, True), "lib/spec.rb": ("ruby", True, False), "app/assets/builds/a.rb": ("ruby", False, False),
    }
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    p = F.col("p")
    got = {r[0]: tuple(r[1:]) for r in df.select(p, paths.language(p), paths.allowed(p), paths.is_test(p)).collect()}
    assert got == rows
    heads = ["# This file is auto-generated from", "x\n# Code generated by x. DO NOT EDIT.", "# mentions that it was generated", "a\nb\nc\nd\ne\n# do not edit", None, "<%# Do not edit %>"]
    df = spark.createDataFrame([(x,) for x in heads], "c string")
    assert [r[0] for r in df.select(paths.generated(F.col("c"))).collect()] == [True, True, False, False, False, True]
    assert spark.range(1).select(paths.snake_case(F.lit("HTMLParserV2Base"))).first()[0] == "html_parser_v2_base"


@pytest.mark.parametrize(
    "pattern,name,matches",
    [("A::*", "A::B", True), ("A::*", "A", False), ("**", "A::B", True), ("A::**::C", "A::C", True), ("A::**::C", "A::B::B::C", True), ("A::**::C", "A::B", False), ("*B", "AB", True), ("[AB]x", "Bx", True), ("[^A]x", "Ax", False), ("A?", "AB", True), ("", "", True)],
)
def test_segment_globs(pattern, name, matches):
    assert references.segments_match(pattern.split("::"), name.split("::")) is matches


def test_pathological_glob_is_fast():
    assert not references.segments_match(["**", "a"] * 40, ["b"] * 40)
    assert references.segments_match(["**"] * 40, ["b"] * 40)


def test_template_globs():
    match = lambda g, x: bool(references.template_pattern(g).fullmatch(x))
    assert match("views/*/show", "views/a/show") and not match("views/*/show", "views/a/b/show")
    assert match("views/**/show", "views/show") and match("views/**/show", "views/a/b/show") and match("views/**", "views/a/b") and not match("views/a.b", "views/axb")


def test_reference_kinds_and_order(spark):
    df = spark.createDataFrame([("A#b",), ("A.b",), ("a/b",), ("A::*",), ("A::B",), ("A::**",)], "t string")
    got = {r[0]: (r[1], list(r[2])) for r in df.select("t", references.reference_kind(F.col("t")), references.specificity(F.col("t"))).collect()}
    assert [got[x][0] for x in ("A#b", "A.b", "a/b", "A::*", "A::B")] == ["method", "method", "template_glob", "const_glob", "constant"]
    assert got["A#b"][1] > got["A::B"][1] > got["A::*"][1] > got["A::**"][1]
    assert math.isfinite(got["a/b"][1][0])
