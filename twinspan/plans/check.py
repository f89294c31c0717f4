"""The whole check: sweep the head, compare with a base, and say what to do."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspan.functions import paths as path_rules
from twinspan.operators import clusters, contract, findings, similarity
from twinspan.plans import cache, report
from twinspan.plans.sweep import Sweep, sweep
from twinspan.sources import files, git
from twinspan.sources.documents import Contract, load_contract, read_contract
from twinspan.work import Workspace

NORMALIZER = report.NORMALIZER
#: Other places that a report lists of one finding; all are in the table of locations.
OTHERS = 1000


class UsageError(ValueError):
    """What was asked for can't be done."""


@dataclass
class Options:
    root: str = "."
    base: str | None = None
    paths: list[str] = field(default_factory=list)
    overrides: dict[str, int] = field(default_factory=dict)  # threshold in millionths, min_lines, min_nodes
    include_tests: bool = False
    introduced_only: bool = False
    contract: str = "contract"
    cache: str | None = None
    page: int = 10_000  # rows of each of a report's lists; the result's tables have all


def run(spark: SparkSession, options: Options) -> report.Result:
    """Check a folder. Without git, or a base, findings are unlabelled."""
    root = os.path.abspath(options.root)
    if not os.path.isdir(root):
        raise UsageError(f"no such folder: {options.root}")
    for path in options.paths:
        if not os.path.exists(os.path.join(root, path)):
            raise UsageError(f"no such path: {path}")
    work = Workspace(spark, "check")
    versioned = git.is_repository(root)
    listing = git.head_files(root) if versioned else files.walked(root)
    declared = load_contract(root, options.contract)
    head = sweep(spark, files.read_files(spark, root, listing), declared, work, options.include_tests, options.overrides)
    base = _base_commit(root, options.base) if versioned else None
    old = _base(spark, root, base, options, work) if base else None
    return _verdict(spark, root, options, head, declared, base, old, versioned, work)


def _base_commit(root: str, ref: str | None) -> str | None:
    if ref is not None:
        if git.resolve(root, ref) is None:
            raise UsageError(f"unknown base: {ref}")
        return git.merge_base(root, ref)
    branch = git.default_branch(root)
    return git.merge_base(root, branch) if branch else None


def _base(spark: SparkSession, root: str, commit: str, options: Options, work: Workspace) -> dict[str, DataFrame]:
    """The base's summary, from the cache or a sweep of its files."""
    key = cache.cache_key(commit, NORMALIZER, options.include_tests, git.prefix(root), options.contract, options.overrides)
    if options.cache and (found := cache.read(spark, options.cache, key)):
        return found
    declared = _contract_at(root, commit, options.contract)
    old = sweep(spark, git.contents_at(spark, root, commit), declared, work, options.include_tests, options.overrides)
    summary = summarize(spark, old, declared, work)
    if options.cache:
        cache.write(summary, options.cache, key)
    return summary


def _contract_at(root: str, commit: str, folder: str) -> Contract:
    wanted = [(p, b) for p, b in git.files_at(root, commit) if p.startswith(folder.rstrip("/") + "/") and p.endswith(".md")]
    return read_contract([(p, data or b"") for (p, _), data in zip(wanted, git.read_blobs(root, [b for _, b in wanted]), strict=True)], folder)


def summarize(spark: SparkSession, swept: Sweep, declared: Contract, work: Workspace) -> dict[str, DataFrame]:
    """Clusters by key and by structure, pairs, and clause keys of a sweep."""
    members = clusters.components(swept.matches, "a", "b", work)
    keyed = members.join(swept.locations, F.col("id") == F.col("loc_id")).select("component", "key", "structural")
    first = keyed.groupBy("component").agg(F.min("key").alias("_first"))
    # a cluster's number is a hash of its least key: the same wherever the summary is made
    named = keyed.join(first, "component").select("key", "structural", F.xxhash64("_first").alias("cluster"))
    pairs = key_pairs(swept)
    clauses = spark.createDataFrame([(c["key"],) for c in declared.clauses], "key string")
    return {"clusters": work.write(named.select("key", "cluster").distinct(), "clusters"), "structures": work.write(named.select("structural", "cluster").distinct(), "structures"), "pairs": work.write(pairs, "pairs"), "clauses": clauses}


def key_pairs(swept: Sweep) -> DataFrame:
    """(ka, kb, sa, sb, score, a, b): the keys and shapes of matched locations, the least of each two first."""
    shown = F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line")
    side = lambda k: swept.locations.select(F.col("loc_id").alias(k), F.struct("key", "structural", shown.alias("at")).alias(f"_{k}"))
    both = swept.matches.select("a", "b", "score").join(side("a"), "a").join(side("b"), "b")
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    shapes = (low["structural"], high["structural"])
    return both.select(low["key"].alias("ka"), high["key"].alias("kb"), F.least(*shapes).alias("sa"), F.greatest(*shapes).alias("sb"), "score", low["at"].alias("a"), high["at"].alias("b")).distinct()


def _verdict(spark, root, options, head: Sweep, declared: Contract, base, old, versioned: bool, work: Workspace) -> report.Result:  # noqa: ANN001
    clauses = spark.createDataFrame([(k, c["path"], c["line"], c["key"]) for k, c in enumerate(declared.clauses)], "clause_id int, path string, line int, key string")
    keeping = spark.createDataFrame([], "match_id bigint, clause_id int")
    unnamed: list[tuple[str, int, str]] = []
    if head.hits is not None:
        own = contract.assigned(head.hits.where("clause_id >= 0").select("ref_id", "entry_id"), head.hits.where("clause_id >= 0").select("clause_id", "ref_id", "text").distinct())
        keeping = work.write(contract.kept(head.matches.select("match_id", "ea", "eb"), own, clauses), "kept")
        named = {(r["path"], r["line"]) for r in head.hits.select("path", "line").distinct().collect()}  # references people wrote
        written = [(p, n, t) for _, t, p, n in declared.covers] + [(c["path"], n, t) for c in declared.clauses for t, n in c["references"]]
        unnamed = [(p, n, f"no unit is called {t}") for p, n, t in sorted(set(written)) if (p, n) not in named]
    unkept = head.matches.join(keeping, "match_id", "left_anti").select("match_id", "a", "b", "score")
    if head.hits is not None:
        unkept = unkept.unionByName(_twins(head, keeping, own, work))
    unkept = work.write(unkept, "unkept")
    members = clusters.components(unkept, "a", "b", work).withColumnRenamed("id", "loc_id")
    placed = members.join(head.locations, "loc_id")
    changed = git.changed_lines(spark, root, base) if base else spark.createDataFrame([], "path string, from_line int, to_line int")
    placed = work.write(findings.touched(placed, changed), "touched")
    times = git.blame(placed.where("not touched").select("path"), root) if versioned else spark.createDataFrame([], "path string, line int, ts double")
    placed = work.write(findings.aged(placed, times), "placed")
    labelled = findings.labels(placed, old["clusters"], old["structures"]) if old else placed.select("component", F.lit("found").alias("label")).distinct()
    shown = findings.narrowed(placed, options.paths)
    ends = work.write(findings.originals(placed).join(shown, "component"), "ends")
    told = _told(placed, _edges(head, placed, unkept, ends, work), ends, labelled, bool(old))
    result = report.Result(base=base, notes=findings.notes(bool(old), bool(options.overrides), options.paths, options.introduced_only))
    told = work.write(told, "findings")
    result.totals = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    result.findings = [_finding(r) for r in told.orderBy(F.array_position(F.array(*map(F.lit, findings.ORDER)), F.col("label")), F.desc("payoff"), "c.path", "c.start_line", "c.end_line", "c.identity").limit(options.page).collect()]
    kept = work.write(_kept(head, keeping), "kept")
    result.kept = _kept_rows(kept.orderBy("_a", "_b").limit(options.page), declared, old)
    result.totals["kept"] = kept.count()
    result.tables = {"findings": told, "locations": placed, "kept": kept, "parse_errors": head.errors}
    if old:
        lost = findings.contracted(old["pairs"], key_pairs(head)).join(old["pairs"].select("ka", "kb", "a", "b").distinct(), ["ka", "kb"])
        lost = result.tables["contracted"] = work.write(lost, "contracted")
        result.contracted = [(r["a"], r["b"], r["score"]) for r in lost.orderBy("ka", "kb").limit(options.page).collect()]
        result.totals["contracted"] = lost.count()
    stale = [(r["path"], r["line"], "the clause keeps no match and can go") for r in contract.stale(clauses, keeping).orderBy("path", "line").collect()]
    result.clause_errors = [*declared.errors, *unnamed, *stale]
    result.parse_errors = [tuple(r) for r in head.errors.select("path", "line", "message").orderBy("path", "line").limit(options.page).collect()]
    found = {k: result.totals.get(k, 0) for k in findings.ORDER}
    failing = sum(found[k] for k in findings.FAILING)
    result.exit_code = findings.exit_code(sum(found.values()), failing, len(result.clause_errors), len(result.parse_errors), bool(options.overrides), options.introduced_only)
    return result


def _twins(head: Sweep, keeping: DataFrame, own: DataFrame, work: Workspace) -> DataFrame:
    """Pairs of identical units that kept matches hide, with the score of the kept match; each meets its own settings."""
    whole = head.matches.join(keeping.select("match_id"), "match_id", "left_semi").where("wa and wb")
    groups = head.units.select("entry_id", F.col("root_digest").alias("group"))
    x, y = groups.withColumnsRenamed({"entry_id": "ea", "group": "ga"}), groups.withColumnsRenamed({"entry_id": "eb", "group": "gb"})
    between = whole.select("ea", "eb", "score").join(x, "ea").join(y, "eb")
    matched = head.locations.where("whole").select("entry_id").distinct()
    pairs = work.write(contract.unkept_twins(between.select("ga", "gb"), groups.join(matched, "entry_id"), own), "twins")
    score = between.select(F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2"), "score").groupBy("g1", "g2").agg(F.max("score").alias("kept_score"))
    told = pairs.join(x, "ea").join(y, "eb").withColumn("g1", F.least("ga", "gb")).withColumn("g2", F.greatest("ga", "gb")).join(score, ["g1", "g2"], "left")
    told = told.withColumn("score", F.when(F.col("ga") == F.col("gb"), 1.0).otherwise(F.col("kept_score"))).where("score is not null")
    unit = lambda k: head.units.select(*(F.col(c).alias(f"{c}_{k}") for c in ("entry_id", "start_line", "end_line", "node_count", "threshold", "min_lines", "min_nodes")))
    both = told.join(unit("a"), F.col("ea") == F.col("entry_id_a")).join(unit("b"), F.col("eb") == F.col("entry_id_b"))
    lines = F.least(F.col("end_line_a") - F.col("start_line_a"), F.col("end_line_b") - F.col("start_line_b")) + 1
    fits = (lines >= F.least("min_lines_a", "min_lines_b")) & (F.least("node_count_a", "node_count_b") >= F.least("min_nodes_a", "min_nodes_b"))
    enough = F.col("score") * 1_000_000 >= F.least("threshold_a", "threshold_b")
    place = lambda k: F.xxhash64(f"entry_id_{k}", f"start_line_{k}", f"end_line_{k}")
    rows = both.where(fits & enough).select(F.xxhash64("ea", "eb").alias("match_id"), place("a").alias("a"), place("b").alias("b"), "score")
    return rows.join(head.matches.select("a", "b").unionByName(head.matches.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti").select("match_id", "a", "b", "score")


def _edges(head: Sweep, placed: DataFrame, unkept: DataFrame, ends: DataFrame, work: Workspace) -> DataFrame:
    """Scores of matches, and of each copy with the places of its cluster that it wasn't matched with."""

    def score(pairs: DataFrame) -> DataFrame:
        named = work.write(pairs, "unscored")
        some = named.select(F.explode(F.array("a", "b")).alias("loc_id")).distinct()
        return similarity.scored(named, work.write(head.tokens(placed.join(some, "loc_id", "left_semi")), "tokens"), "loc_id")

    return work.write(findings.completed(placed, unkept, ends, score), "scores")


def _told(placed: DataFrame, edges: DataFrame, ends: DataFrame, labelled: DataFrame, based: bool) -> DataFrame:
    """A row per finding, its first OTHERS other places in an array, and how many there are."""
    ends_scored = findings.end_scores(placed, edges, ends)
    scores = ends_scored.where("loc_id <> copy").select("component", "loc_id", F.coalesce("with_copy", F.lit(0.0)).alias("score"))
    place = F.struct("path", "start_line", "end_line", "identity", F.col("size").alias("nodes"), "touched", "language", "whole")
    each = scores.join(placed.select("loc_id", place.alias("p")), "loc_id").select("component", F.struct((-F.col("score")).alias("s"), F.col("p.path").alias("o1"), F.col("p.start_line").alias("o2"), F.col("p.end_line").alias("o3"), "p").alias("o"))
    first = each.withColumn("_k", F.row_number().over(Window.partitionBy("component").orderBy("o"))).where(F.col("_k") <= OTHERS)
    others = first.groupBy("component").agg(F.array_sort(F.collect_list("o")).alias("others"))
    copies = ends.join(placed.select(F.col("loc_id").alias("copy"), place.alias("c")), "copy")
    covered = ends.join(placed.select(F.col("loc_id").alias("original"), "primitive"), "original").select("component", "primitive")
    rows = copies.join(others, "component").join(findings.cluster_kinds(placed), "component").join(findings.payoffs(placed, ends_scored), "component").join(labelled, "component").join(covered, "component")
    rows = rows.withColumn("language", F.col("c.language")).withColumn("existing", F.col("others")[0]["p"]["identity"]).withColumn("has_base", F.lit(based))
    rows = rows.withColumn("existing_partial", F.col("others")[0]["p"]["whole"] & path_rules.base_name(F.col("others")[0]["p"]["path"]).startswith("_"))
    return rows.withColumn("hint", findings.hints()).select("component", "label", "kind", "members", "c", "others", "hint", "payoff", "primitive")


def _place(p) -> report.Place:  # noqa: ANN001
    return report.Place(p["path"], p["start_line"], p["end_line"], p["identity"], p["nodes"], p["touched"], p["language"])


def _finding(r) -> report.Finding:  # noqa: ANN001
    others = [(_place(o["p"]), -o["s"]) for o in r["others"]]
    return report.Finding(r["label"], r["kind"], others[0][1], _place(r["c"]), others, r["hint"], r["payoff"], r["primitive"], r["members"] - 1 - len(others))


def _kept(head: Sweep, keeping: DataFrame) -> DataFrame:
    """Kept matches with their places and clauses."""
    place = lambda k: head.locations.select(F.col("loc_id").alias(k), F.struct("path", "start_line", "end_line", "identity", F.col("size").alias("nodes"), F.lit(False).alias("touched"), "language").alias(f"_{k}"))
    return head.matches.join(keeping, "match_id").join(place("a"), "a").join(place("b"), "b").select("score", "clause_id", "_a", "_b")


def _kept_rows(kept: DataFrame, declared: Contract, old: dict | None) -> list[dict]:
    known = {r["key"] for r in old["clauses"].collect()} if old else None  # clauses people wrote
    out = []
    for r in kept.collect():
        clause = declared.clauses[r["clause_id"]]
        out.append({"score": r["score"], "a": _place(r["_a"]), "b": _place(r["_b"]), "path": clause["path"], "line": clause["line"], "heading": clause["heading"], "new_clause": known is not None and clause["key"] not in known})
    return out


def explain(spark: SparkSession, options: Options, a: str, b: str) -> str:
    """Two units' trees, their score, and the digests they share, as text."""
    from twinspan.operators.similarity import explained
    from twinspan.sources import units

    root = os.path.abspath(options.root)
    work = Workspace(spark, "explain")
    listing = git.head_files(root) if git.is_repository(root) else files.walked(root)
    read = files.read_files(spark, root, listing)
    swept = sweep(spark, read, load_contract(root, options.contract), work, options.include_tests)
    found = {r["identity"]: r["entry_id"] for r in swept.units.where(F.col("identity").isin(a, b)).select("identity", "entry_id").collect()}
    for name in (a, b):
        if name not in found:
            raise UsageError(f"no unit named {name}")
    good, _ = files.decoded(read)
    sources = files.source_files(good, options.include_tests, "text")
    rows = units.read_units(sources, "path", "path", "language", "text").where(F.col("identity").isin(a, b)).collect()
    trees = {r["identity"]: r["nodes"] for r in rows}
    row = explained(swept.weighted, "entry_id", found[a], found[b]).first()
    out = []
    for name in (a, b):
        out.append(name)
        out += ["  " * (n["depth"] + 1) + n["kind"] + (f":{n['label']}" if n["label"] else "") for n in trees[name]]
    score = row["shared_w"] / row["union_w"] if row["union_w"] else 0.0
    out.append(f"score {round(score, 2)}: {row['shared_digests']} of {row['union_digests']} fingerprints shared")
    return "\n".join(out) + "\n"
