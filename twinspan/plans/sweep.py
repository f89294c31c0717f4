"""One sweep of a snapshot: files to units, digests, matches and locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.weights import reaches
from twinspan.operators import contract as rules
from twinspan.operators import fingerprints, fragments, identical, similarity
from twinspan.sources import files, units
from twinspan.sources.documents import Contract
from twinspan.work import Workspace

DEFAULTS = (800_000, 4, 20)
LOCATION = ["entry_id", "start_line", "end_line"]
#: A pair's columns: of each side entry, lines, size, whole, signature, first and last node, and which of its like in the
#: unit it is.
PAIR = [*(c + x for x in "ab" for c in "estzwgflo"), "kind", "shared_w", "union_w"]


@dataclass
class Sweep:
    """Tables of a swept snapshot."""

    units: DataFrame
    errors: DataFrame
    matches: DataFrame  # a, b (location ids), kind, score, shared_w, union_w
    locations: DataFrame
    hits: DataFrame | None
    weighted: DataFrame
    nodes: DataFrame

    def tokens(self, locations: DataFrame) -> DataFrame:
        """(loc_id, digest, w): the set of each location: the digests of the subtrees between its first and last node."""
        x = locations.select("loc_id", "entry_id", "from_at", "to_at")
        inside = x.join(self.nodes.select("entry_id", "preorder", "digest"), "entry_id").where("preorder between from_at and to_at")
        return inside.select("loc_id", "entry_id", "digest").distinct().join(self.weighted.select("entry_id", "digest", "w"), ["entry_id", "digest"]).select("loc_id", "digest", "w")


def sweep(spark, read: DataFrame, contract: Contract, work: Workspace, include_tests: bool = False, overrides: dict | None = None) -> Sweep:
    """Sweep files (path, content BINARY). overrides replaces every threshold (millionths), min_lines and min_nodes."""
    good, bad = files.decoded(read)
    sources = work.write(files.source_files(good, include_tests, "text"), "sources")
    listed, nodes, unread = units.units_in_order(sources, work)
    work.drop(sources)
    errors = bad.unionByName(unread)
    roots = nodes.where("parent < 0").select("entry_id", F.col("digest").alias("root_digest"), F.col("size").alias("node_count"))
    table = listed.join(roots, "entry_id")
    hits, table = _settings(spark, table, contract, overrides, work)
    sets = work.write(nodes.groupBy("entry_id").agg(F.collect_set("digest").alias("digests")), "sets")
    weighted = similarity.weighted_sets(sets, "entry_id", work)
    found = _matches(table, nodes, weighted, work)
    return Sweep(table, errors, *found, hits, weighted, nodes)


def _settings(spark, table: DataFrame, contract: Contract, overrides: dict | None, work: Workspace) -> tuple[DataFrame | None, DataFrame]:
    """Reference hits, and units with their primitive and settings."""
    refs = [(text, path, line, primitive, -1) for primitive, text, path, line in contract.covers]
    for k, clause in enumerate(contract.clauses):
        refs += [(text, clause["path"], line, clause["primitive"], k) for text, line in clause["references"]]
    hits = None
    table = table.withColumn("primitive", F.lit(None).cast("string"))
    if refs:
        rows = spark.createDataFrame([(k, *r) for k, r in enumerate(refs)], "ref_id bigint, text string, path string, line int, primitive string, clause_id int")
        hits = work.write(rules.reference_hits(rows.select("ref_id", "text"), table).join(rows, "ref_id"), "hits")
        covers = rows.where("clause_id < 0").select("primitive", "ref_id", "text")
        own = rules.primitive_of(hits.select("ref_id", "entry_id"), covers)
        table = table.drop("primitive").join(own, "entry_id", "left")
    declared = [(p, int(round(s["threshold"] * 1_000_000)) if "threshold" in s else None, s.get("min_lines"), s.get("min_nodes")) for p, s in contract.settings.items()]
    settings = spark.createDataFrame(declared, "primitive string, threshold bigint, min_lines int, min_nodes int")
    table = rules.unit_settings(table, settings, "primitive", DEFAULTS)
    for key, value in (overrides or {}).items():
        table = table.withColumn(key, F.lit(value).cast(table.schema[key].dataType))
    return hits, work.write(table, "settled")


def _pair_settings(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Add the lower threshold and floors of the two entries ea and eb."""
    x = table.select(F.col("entry_id").alias("ea"), F.col("path").alias("_pa"), *(F.col(c).alias(f"a_{c}") for c in ("threshold", "min_lines", "min_nodes")))
    y = table.select(F.col("entry_id").alias("eb"), F.col("path").alias("_pb"), *(F.col(c).alias(f"b_{c}") for c in ("threshold", "min_lines", "min_nodes")))
    both = pairs.join(x, "ea").join(y, "eb")
    for c in ("threshold", "min_lines", "min_nodes"):
        both = both.withColumn(c, F.least(f"a_{c}", f"b_{c}")).drop(f"a_{c}", f"b_{c}")
    return both


def _judged(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Candidate pairs (ea, sa, ta, za, eb, sb, tb, zb, kind, shared_w, union_w) that don't overlap and meet their settings."""
    told = _pair_settings(pairs, table)
    clash = (F.col("_pa") == F.col("_pb")) & (F.col("sa") <= F.col("tb")) & (F.col("sb") <= F.col("ta"))
    lines = F.least(F.col("ta") - F.col("sa"), F.col("tb") - F.col("sb")) + 1 >= F.col("min_lines")
    nodes = F.least("za", "zb") >= F.col("min_nodes")
    return told.where(~clash & lines & nodes & reaches(F.col("shared_w"), F.col("union_w"), F.col("threshold"), 1_000_000)).select(*PAIR)


def _side(table: DataFrame, x: str) -> DataFrame:
    """A whole unit as one side of a pair."""
    return table.select(F.col("entry_id").alias(f"e{x}"), F.col("start_line").alias(f"s{x}"), F.col("end_line").alias(f"t{x}"), F.col("node_count").alias(f"z{x}"), F.lit(True).alias(f"w{x}"), F.lit(None).cast("string").alias(f"g{x}"), F.lit(0).alias(f"f{x}"), (F.col("node_count") - 1).alias(f"l{x}"), F.lit(1).alias(f"o{x}"))


def _matches(table: DataFrame, nodes: DataFrame, weighted: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    floor = table.agg(F.min("threshold"), F.min("min_lines"), F.min("min_nodes")).first()
    threshold, min_lines, min_nodes = (v if v is not None else d for v, d in zip(floor, DEFAULTS, strict=True))
    eligible = work.write(table.where((F.col("end_line") - F.col("start_line") + 1 >= min_lines) & (F.col("node_count") >= min_nodes)), "eligible")
    # whole units: stars of identical ones, near pairs of their representatives, and those who stand in for them
    star = work.write(identical.identical_stars(eligible), "star")
    reps = work.write(identical.representatives(eligible), "reps")
    first = reps.where("entry_id = rep_id").select("entry_id")
    near = similarity.similar_units(weighted.join(first, "entry_id", "left_semi"), "entry_id", threshold, 1_000_000, work)
    near = identical.stood_in(near, reps, star)
    totals = weighted.groupBy("entry_id").agg(F.sum("w").alias("total"))
    same = star.join(totals, F.col("a") == F.col("entry_id")).select("a", "b", F.col("total").alias("shared_w"), F.col("total").alias("union_w"))
    pairs = near.select("a", "b", "shared_w", "union_w").unionByName(same).dropDuplicates(["a", "b"]).withColumnsRenamed({"a": "ea", "b": "eb"}).withColumn("kind", F.lit("unit"))
    whole = pairs.join(_side(eligible, "a"), "ea").join(_side(eligible, "b"), "eb")
    # copied subtrees
    inside = nodes.join(eligible.select("entry_id", "path", "min_lines", "min_nodes"), "entry_id")
    inside = fingerprints.ordinals(inside, ["entry_id", "digest"], ["preorder"])
    trees = inside.where((F.col("parent") >= 0) & (F.col("size") >= min_nodes) & (F.col("end_line") - F.col("start_line") + 1 >= min_lines))
    trees = work.write(trees.select(F.xxhash64("entry_id", "preorder").alias("loc_id"), "entry_id", "preorder", "subtree_end", "path", "start_line", "end_line", "size", "ordinal", F.col("digest").alias("signature"), "min_lines", "min_nodes"), "subtrees")
    copied = fragments.fragment_pairs(trees)
    cut = lambda x, k: trees.select(F.col("loc_id").alias(k), F.col("entry_id").alias(f"e{x}"), F.col("start_line").alias(f"s{x}"), F.col("end_line").alias(f"t{x}"), F.col("size").alias(f"z{x}"), F.lit(False).alias(f"w{x}"), F.col("signature").alias(f"g{x}"), F.col("preorder").alias(f"f{x}"), F.col("subtree_end").alias(f"l{x}"), F.col("ordinal").alias(f"o{x}"))
    subtree = copied.join(cut("a", "a"), "a").join(cut("b", "b"), "b").withColumn("kind", F.lit("subtree")).withColumn("shared_w", F.lit(1).cast("bigint")).withColumn("union_w", F.lit(1).cast("bigint"))
    every = whole.select(*PAIR).unionByName(subtree.select(*PAIR)).unionByName(_runs(inside, weighted, work).select(*PAIR))
    told = work.write(_judged(every, table), "judged")
    marked = told.select(F.xxhash64("ea", "sa", "ta", "eb", "sb", "tb", "kind").alias("match_id"), "*").dropDuplicates(["match_id"])
    marked = marked.withColumn("whole", F.col("wa") & F.col("wb")).withColumn("size", F.greatest("za", "zb")).withColumn("ka", F.concat_ws("@", "ea", "sa", "ta")).withColumn("kb", F.concat_ws("@", "eb", "sb", "tb"))
    kept = fragments.pruned(work.write(fragments.without_twins(marked, eligible.select("entry_id", F.col("root_digest").alias("group"))), "marked"))
    loc = lambda x: F.xxhash64(f"e{x}", f"s{x}", f"t{x}")
    ends = kept.select("match_id", loc("a").alias("a"), loc("b").alias("b"), *PAIR)
    ends = work.write(ends.withColumn("score", F.col("shared_w") / F.col("union_w")), "matches")
    return ends, work.write(_locations(ends, table), "locations")


def _runs(inside: DataFrame, weighted: DataFrame, work: Workspace) -> DataFrame:
    """Runs of statements that two sequences share, but for one differing statement: the extended run, and its core."""
    sequences = inside.where("is_sequence and size(child_digests) >= 3").select(F.xxhash64("entry_id", "preorder").alias("seq_id"), "entry_id", "preorder", F.col("child_digests").alias("digests"))
    sequences = work.write(sequences, "sequences")
    placed = inside.select("entry_id", F.col("parent").alias("preorder"), F.struct("pos", "start_line", "end_line").alias("kid")).join(sequences.select("seq_id", "entry_id", "preorder"), ["entry_id", "preorder"])
    lines = placed.groupBy("seq_id").agg(F.array_sort(F.collect_list("kid")).alias("kids")).select("seq_id", F.col("kids.start_line").alias("starts"), F.col("kids.end_line").alias("ends"))
    seeds = fragments.run_seeds(sequences.select("seq_id", "digests").join(lines, "seq_id"))
    runs = work.write(fragments.extended_runs(seeds, sequences.select("seq_id", "digests")), "runs")
    long = runs.select("a", "b", "diagonal", "first", "last").unionByName(runs.select("a", "b", "diagonal", F.col("core_first").alias("first"), F.col("core_last").alias("last"))).distinct()
    # an entry's own children give where a run's statements begin and end in preorder
    kids = inside.select("entry_id", F.col("parent").alias("preorder"), "pos", F.col("preorder").alias("at"), "subtree_end", "size", "start_line", "end_line", "digest").join(sequences.select("seq_id", "entry_id", "preorder"), ["entry_id", "preorder"])
    place = lambda seq, lo, hi: long.select(F.col(seq).alias("seq_id"), lo.alias("lo"), hi.alias("hi")).distinct()
    spans = place("a", F.col("first"), F.col("last")).unionByName(place("b", F.col("first") - F.col("diagonal"), F.col("last") - F.col("diagonal"))).distinct()
    held = spans.join(kids, "seq_id").where("pos between lo and hi").groupBy("seq_id", "entry_id", "lo", "hi").agg(
        F.min("at").alias("from_at"), F.max("subtree_end").alias("to_at"), F.sum("size").cast("int").alias("z"), F.min("start_line").alias("s"), F.max("end_line").alias("t"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own")
    )
    held = work.write(held.select("seq_id", "entry_id", "lo", "hi", "from_at", "to_at", "z", "s", "t", fingerprints.run_digest(F.transform("own", lambda x: x["digest"])).alias("g")), "spans")
    held = work.write(held.join(_run_ordinals(held, sequences), ["seq_id", "lo", "hi"]), "numbered")
    # a run's set is the digests of its statements' subtrees
    sets = held.select("seq_id", "entry_id", "lo", "hi", "from_at", "to_at").join(inside.select("entry_id", F.col("preorder").alias("p"), "digest"), "entry_id").where("p between from_at and to_at").select("seq_id", "lo", "hi", "entry_id", "digest").distinct()
    key = F.struct("seq_id", "lo", "hi").alias("run")
    tokens = work.write(sets.join(weighted, ["entry_id", "digest"]).select(key, "digest", "w"), "run_tokens")
    packed = held.select(key, F.col("entry_id").alias("e"), "s", "t", "z", F.lit(False).alias("w"), "g", F.col("from_at").alias("f"), F.col("to_at").alias("l"), F.col("ordinal").alias("o"))
    pair = long.select(F.struct(F.col("a").alias("seq_id"), F.col("first").alias("lo"), F.col("last").alias("hi")).alias("a"), F.struct(F.col("b").alias("seq_id"), (F.col("first") - F.col("diagonal")).alias("lo"), (F.col("last") - F.col("diagonal")).alias("hi")).alias("b"))
    scored = similarity.scored(pair.distinct(), tokens, "run")
    side = lambda x: packed.select(F.col("run").alias(x), *(F.col(c).alias(f"{c}{x}") for c in "estzwgflo"))
    return scored.join(side("a"), "a").join(side("b"), "b").withColumn("kind", F.lit("run"))


def _run_ordinals(held: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, lo, hi, ordinal): which of the equal runs in its unit's sequences, in order, each run is."""
    wanted = held.select("entry_id", "g", (F.col("hi") - F.col("lo") + 1).alias("k")).distinct()
    at = F.explode(F.when(F.size("digests") >= F.col("k"), F.sequence(F.lit(0), F.size("digests") - F.col("k"))).otherwise(F.array().cast("array<int>"))).alias("lo")
    spots = wanted.join(sequences, "entry_id").select("entry_id", "g", "k", "seq_id", "preorder", "digests", at)
    same = spots.where(fingerprints.run_digest(F.slice("digests", F.col("lo") + 1, F.col("k"))) == F.col("g"))
    numbered = fingerprints.ordinals(same, ["entry_id", "g"], ["preorder", "lo"])
    return numbered.select("seq_id", "lo", (F.col("lo") + F.col("k") - 1).alias("hi"), "ordinal")


def _locations(matches: DataFrame, table: DataFrame) -> DataFrame:
    """The sides of matches, each once, with their units and keys."""
    side = lambda x: matches.select(F.col(x).alias("loc_id"), F.col(f"e{x}").alias("entry_id"), F.col(f"s{x}").alias("start_line"), F.col(f"t{x}").alias("end_line"), F.col(f"z{x}").alias("size"), F.col(f"w{x}").alias("whole"), F.col(f"g{x}").alias("signature"), F.col(f"f{x}").alias("from_at"), F.col(f"l{x}").alias("to_at"), F.col(f"o{x}").alias("ordinal"))
    sides = side("a").unionByName(side("b"))
    each = sides.groupBy("loc_id", *LOCATION).agg(F.max("size").alias("size"), F.some("whole").alias("whole"), F.min("signature").alias("signature"), F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"), F.min_by("ordinal", F.struct("signature", "ordinal")).alias("ordinal"))
    told = each.join(table.select("entry_id", "path", "kind", "identity", "namespace", "language", "root_digest", "primitive"), "entry_id")
    unpadded = F.regexp_replace("signature", "^0+(?=.)", "")
    part: Column = F.when(F.col("whole"), F.lit("")).otherwise(F.concat(F.lit("@"), unpadded, F.lit("#"), "ordinal"))
    key = F.concat("path", F.lit("#"), "identity", part)
    structural = F.when(F.col("whole"), F.regexp_replace("root_digest", "^0+(?=.)", "")).otherwise(F.concat(F.regexp_replace("root_digest", "^0+(?=.)", ""), part))
    return told.withColumn("key", key).withColumn("structural", structural)
